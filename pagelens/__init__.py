"""pagelens: a PySpark-native site audit engine."""
