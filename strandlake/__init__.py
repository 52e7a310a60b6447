"""A PySpark-native engine for sequence and graph-shaped data."""
