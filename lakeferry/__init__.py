"""A PySpark-native engine that copies tables to and from files addressed by URL, and queries them."""

__version__ = "0.1.0"
