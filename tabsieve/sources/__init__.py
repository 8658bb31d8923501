"""Readers, writers and previews."""
