"""Structured Streaming jobs: block-range ingest and feed replication."""
