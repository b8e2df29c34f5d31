"""Relational operators of the fact layer: DataFrames in, DataFrames out."""
