"""Spark-native exact clustering analytics."""
