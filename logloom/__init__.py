"""Spark-native security-log analytics."""
