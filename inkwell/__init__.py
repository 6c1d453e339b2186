"""inkwell - a Spark-first engine for checking and measuring prose at scale."""

__version__ = "0.1.0"
