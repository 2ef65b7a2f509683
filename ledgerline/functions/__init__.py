"""Scalar functions: each takes columns and returns a column, built from Spark's own functions."""
