"""Structured Streaming forms of the plans."""
