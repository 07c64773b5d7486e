"""Readers of documents and pages, and the collection store."""
