"""Operators for large training-data corpora; nothing else in the library imports this."""
