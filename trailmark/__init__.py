"""Spark-native analytics for frame metrics, annotations and image manifests."""

__version__ = "0.1.0"
