"""Time-series anomaly detection on Spark DataFrames."""

from tidemark.spec import SeriesSpec

__all__ = ["SeriesSpec"]
