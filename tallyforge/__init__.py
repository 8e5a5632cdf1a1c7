"""Spark-native extraction, reconciliation and training-data preparation for free-text reports."""

__version__ = "0.1.0"
