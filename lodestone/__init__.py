"""Spark-native engine for building, searching and evaluating text-retrieval corpora."""
