"""Whole plans: ingest, retrieval, backfill."""
