"""Spark-native analytics engine for cited document retrieval."""
