"""Operators for text corpora on their way to language-model training.

Nothing outside this package imports it.
"""
