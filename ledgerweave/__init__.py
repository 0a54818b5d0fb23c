"""A PySpark-native engine for assistant activity logs and large text corpora."""
