"""Operators for preparing training text, and their registered queries.

Nothing outside this package imports it.  The operators take and return
DataFrames; ``queries.py`` registers one query for each of them.
"""
