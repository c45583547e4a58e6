"""Relational operators over market tables; each takes and returns DataFrames."""
