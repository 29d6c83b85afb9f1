"""Transcript analytics on Spark: corpus preparation, hypothesis voting and word error rates."""

__version__ = "0.1.0"
