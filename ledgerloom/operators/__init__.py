"""Relational operators of the engine; each takes DataFrames and returns a lazy DataFrame."""
