"""Operators: each takes datasets and returns a lazy dataset."""
