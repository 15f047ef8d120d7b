"""Spark-first short-read alignment dataflow."""

__version__ = "0.1.0"
