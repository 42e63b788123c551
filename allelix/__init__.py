"""A PySpark-native analytics engine for sample-by-site tables."""
