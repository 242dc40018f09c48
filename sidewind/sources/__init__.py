"""Schemas, readers, HTML extraction and sinks."""
