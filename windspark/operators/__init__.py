"""Operators on DataFrames: each takes DataFrames and returns one."""
