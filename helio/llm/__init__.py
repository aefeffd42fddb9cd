"""Operators for large-scale training-data pipelines (see ``queries.py``).

Nothing else in the library imports this subpackage.
"""
