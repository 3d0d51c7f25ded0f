"""Operators for large training-data pipelines.

Nothing else in the package imports this subpackage.  ``queries`` holds the
registered ``opN_*`` queries and their SQL.
"""
