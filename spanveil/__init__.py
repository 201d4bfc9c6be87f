"""Text-privacy analytics on Spark: spans are rows, rules are column expressions."""

__version__ = "0.1.0"
