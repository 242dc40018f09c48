"""sidewind: a PySpark-native analytics engine for two-sided contest data."""
