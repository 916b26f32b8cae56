"""Structured Streaming jobs for incremental ingest and review tags."""
