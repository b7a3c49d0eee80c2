"""Spark-native analytics for long-read sequencing runs."""

__version__ = "0.1.0"
