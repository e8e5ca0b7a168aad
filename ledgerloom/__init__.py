"""Spark-native transaction-graph analytics: tables in, lazily planned tables out."""

__version__ = "0.1.0"
