"""Pair analytics on Spark: pair features, graph features, scoring and post-processing."""

__version__ = "0.1.0"
