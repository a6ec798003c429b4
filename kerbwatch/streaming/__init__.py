"""Operators over streams of records."""
