"""Spark-native analytics over source-code risk data."""
