"""Spark-native engine for building, auditing and evaluating typed-decision datasets."""

__version__ = "0.1.0"
