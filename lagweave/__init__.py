"""Distributed-lag analytics for Spark DataFrames."""
