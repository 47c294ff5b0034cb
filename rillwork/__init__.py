"""Spark-native analytics for sensor networks on a landscape."""
