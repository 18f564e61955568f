"""Incremental ingest as a bounded stream."""
