"""plotmill: a PySpark-native analytics engine for semi-structured listing records."""

__version__ = "0.1.0"
