"""Spark-native factor analytics over bar series."""
