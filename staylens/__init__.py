"""Spark-native review analytics."""
