"""Spark-native analytics over market tapes."""
