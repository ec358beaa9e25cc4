"""Spark-native profiling, validation and comparison of semi-structured business data."""
