"""leafline: a PySpark-native analytics engine for structured-document data."""
