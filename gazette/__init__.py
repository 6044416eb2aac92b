"""gazette: a PySpark-native engine for institutional notices as data."""
