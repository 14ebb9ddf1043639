"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it.  ``queries.QUERIES`` holds the thin query of each operator.
"""
