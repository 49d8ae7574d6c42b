"""plumbline: a PySpark-native analytics engine for point-shaped tables."""

__version__ = "0.1.0"
