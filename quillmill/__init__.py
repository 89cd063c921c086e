"""Spark-native corpus preparation, retrieval and training-data curation."""
