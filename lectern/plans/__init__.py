"""Bindings of stored tables to the logical tables, and session settings."""
