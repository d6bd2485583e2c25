"""Spark-native record linkage, document processing and retrieval."""
