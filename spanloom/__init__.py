"""Spark-native comparison of annotated texts."""
