"""PySpark-native engine for multi-source metadata catalogs."""

__version__ = "0.1.0"
