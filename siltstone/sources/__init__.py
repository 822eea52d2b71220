"""Readers of source trees, code indexes and settings."""
