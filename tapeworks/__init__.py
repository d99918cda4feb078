"""Spark-first analytics for ordered time series."""
