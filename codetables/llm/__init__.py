"""Operators that a large-scale training-data pipeline needs.  Nothing outside this subpackage imports it."""
