"""Formats that are read and written."""
