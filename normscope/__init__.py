"""Spark-native anomaly scoring over sets of local descriptors."""

__version__ = "0.1.0"
