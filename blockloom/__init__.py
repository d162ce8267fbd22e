"""Spark-native operators for block/transaction feeds, record pipelines and request logs."""

__version__ = "0.1.0"
