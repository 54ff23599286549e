"""Relational operators over the logical tables."""
