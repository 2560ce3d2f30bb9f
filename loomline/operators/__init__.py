"""Operators on timelines, references, claims and selections: DataFrames to DataFrames."""
