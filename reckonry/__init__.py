"""Spark-native toolkit for recurring business data: messy sheets in, reconciled figures out."""

__version__ = "0.1.0"
