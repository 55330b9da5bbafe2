"""Spark-native retrieval and indexing engine for source code and text."""

__version__ = "0.1.0"
