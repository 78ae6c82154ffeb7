"""A PySpark-native engine for describing, matching and ranking the columns of a data catalogue."""
