"""Corpus-building operators for large text collections.

Each module holds one operator, its registered query and its oracle (or None).
Nothing outside this subpackage imports it.
"""
