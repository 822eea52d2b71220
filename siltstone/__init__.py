"""Siltstone: a Spark-native engine that indexes, queries and prepares corpora of text and source code."""

__version__ = "0.1.0"
