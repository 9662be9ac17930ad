"""Stateful streaming forms."""
