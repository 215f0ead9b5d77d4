"""Spark-native audit of a classifier's stability under one-count moves in event data."""

__version__ = "0.1.0"
