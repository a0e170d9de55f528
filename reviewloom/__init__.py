"""Spark-native analytics for short user-written reviews and text corpora."""

__version__ = "0.1.0"
