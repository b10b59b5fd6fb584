"""Reads, k-mers, intervals and abundance tables as Spark DataFrames."""
