"""Spark-native engine for conversation data preparation and analysis."""

__version__ = "0.1.0"
