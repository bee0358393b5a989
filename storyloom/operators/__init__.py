"""Relational operators over catalog DataFrames."""
