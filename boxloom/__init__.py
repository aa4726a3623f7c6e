"""boxloom: a PySpark-native analytics engine for object-detection annotation and evaluation data."""

__version__ = "0.1.0"
