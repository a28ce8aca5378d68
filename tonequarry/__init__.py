"""Spark-native analytics for media-asset quality assurance."""
