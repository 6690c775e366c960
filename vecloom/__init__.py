"""Spark-native cosine vector analytics: search, storage, evaluation and data preparation."""

__version__ = "0.1.0"
