"""tidemark: a PySpark-native engine for temporal, schema-as-data analytics."""

__version__ = "0.1.0"
