"""Structured Streaming: incremental ingest and intervals in keyed state."""
