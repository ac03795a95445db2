"""Operators for preparing text corpora.

Each module holds one operator and the thin query that applies it to the
whole test tables. Nothing else in the library imports this package.
"""
