"""Fixtures and named queries over the driver tables."""
