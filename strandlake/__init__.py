"""Spark-native analytics for sparse binary read x position data."""
