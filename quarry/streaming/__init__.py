"""Streams over the one append-only table."""
