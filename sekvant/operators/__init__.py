"""Relational operators: DataFrames in, DataFrames out, always lazy unless stated."""
