"""Operators: DataFrames in, DataFrames out. A query operator takes a table of requests."""
