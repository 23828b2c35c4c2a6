"""Operators for training-data corpora.

Nothing else in ``fieldproof`` imports this subpackage; it can be deleted
without touching the rest of the library.
"""
