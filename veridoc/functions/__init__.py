"""Scalar functions on Columns: boxes and report text."""
