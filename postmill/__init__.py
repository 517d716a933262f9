"""Spark-native analytics over semi-structured text records."""
