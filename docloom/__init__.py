"""Spark-native analytics over documents, retrieval results and their quality."""
