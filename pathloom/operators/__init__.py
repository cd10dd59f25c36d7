"""Operators on path tables."""
