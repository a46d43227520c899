"""Spark-native memory, retrieval and graph analytics."""

__version__ = "0.1.0"
