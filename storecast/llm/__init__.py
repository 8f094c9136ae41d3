"""Operators for preparing language-model training data, and their pipeline.

Nothing else in the package imports this folder; it may be removed as a whole.
"""
