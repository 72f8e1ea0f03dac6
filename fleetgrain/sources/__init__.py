"""Readers, writers and parsers for the feeds and tables."""
