"""A PySpark-native engine for record search, form extraction and corpus preparation."""
