"""Quillspan: a Spark-native document search and analytics engine."""
