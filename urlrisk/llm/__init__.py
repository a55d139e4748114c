"""Operators for preparing training data, and the queries that apply them.

Nothing else in the library imports this package.
"""
