"""Incremental ingest and stateful streams."""
