"""Spark-native analytics over baskets of items."""
