"""Spark-native analytics for layered polygon data and administrative hierarchies."""
