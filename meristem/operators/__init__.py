"""Operators: each takes and returns DataFrames with documented columns."""
