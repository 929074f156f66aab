"""Incremental ingest of per-sample files."""
