"""Continuous appends."""
