"""Spark-native analytics over dependency graphs, change history and text."""
