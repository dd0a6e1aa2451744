"""Operators for large-scale text corpora: one module per operator, one for their queries."""
