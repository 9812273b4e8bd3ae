"""Spark-native contract-drift analytics."""
