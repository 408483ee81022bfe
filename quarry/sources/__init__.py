"""Readers and writers of corpora, tables and the catalogue."""
