"""Readers and writers of networks and tile files."""
