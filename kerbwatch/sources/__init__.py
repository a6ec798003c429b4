"""Readers, writers and the mapping from test tables to records."""
