"""Readers and writers of path tables."""
