"""Temporal event analytics and retrieval on Spark DataFrames."""
