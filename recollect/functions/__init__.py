"""Scalar functions, written as builders of Columns."""
