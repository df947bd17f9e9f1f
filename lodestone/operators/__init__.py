"""DataFrame operators: numbering and splitting, corpora, retrieval, training sets, graphs."""
