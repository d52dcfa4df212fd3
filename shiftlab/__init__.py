"""A PySpark-native engine for abrupt shifts in gridded space x space x time data."""
