"""Spark-native code-quality analytics: DataFrames in, DataFrames out."""
