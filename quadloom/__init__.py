"""quadloom: a PySpark-native engine for statements, records, mentions and texts."""

__version__ = "0.1.0"
