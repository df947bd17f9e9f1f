"""Column functions: text, vectors and triples."""
