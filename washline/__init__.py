"""Spark-native data cleaning and profiling."""
