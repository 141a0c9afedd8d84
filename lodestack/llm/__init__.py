"""Operators that a training-data pipeline over very large text corpora needs.

Nothing else in the library imports this subpackage.
"""
