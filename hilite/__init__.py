"""Timed-comment analytics on Spark DataFrames."""
