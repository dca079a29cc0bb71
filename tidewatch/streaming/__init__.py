"""Restart-safe ingestion with Structured Streaming."""
