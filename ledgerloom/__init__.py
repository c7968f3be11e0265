"""Spark-native retrieval and analytics engine for document-grounded data."""
