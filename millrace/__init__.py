"""Spark-native table, feature, metric and stream operators."""

__version__ = "0.1.0"
