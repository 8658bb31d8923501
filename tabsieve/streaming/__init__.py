"""Cleaning steps on Structured Streaming."""
