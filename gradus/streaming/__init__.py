"""Filters on streams."""
