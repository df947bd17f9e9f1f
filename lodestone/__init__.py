"""Spark-native engine for retrieval corpora, question sets, triples and training data."""
