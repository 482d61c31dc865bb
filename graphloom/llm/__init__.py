"""Operators that a training-data pipeline needs; nothing else in the library imports this package.

All operators read only the columns they name, so further columns, also such with the names of results, don't matter.
"""
