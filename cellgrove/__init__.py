"""Spark-native analytics for spatial single-cell tables."""
