"""Operators on samples: each takes and returns DataFrames."""
