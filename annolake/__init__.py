"""A PySpark-native engine for document-annotation analytics."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
