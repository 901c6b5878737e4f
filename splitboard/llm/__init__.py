"""Operators for large training-data corpora. Nothing outside this package imports it."""
