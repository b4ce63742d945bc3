"""Incremental keyed ingest, in batch and as a stream."""
