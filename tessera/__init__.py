"""Spark-native analytics over layered symbol-and-relationship data."""
