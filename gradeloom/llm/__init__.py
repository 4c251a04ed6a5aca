"""Operators for large-scale training-data preparation.

Nothing outside this package imports it; the package may be removed as a whole.
"""
