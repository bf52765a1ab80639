"""Spark-native analytics for galaxy-brightness tables."""
