"""Spark-native dataset engine: ingest, query, transform, profile, discover."""

__version__ = "0.1.0"
