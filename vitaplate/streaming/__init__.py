"""Incremental ingestion of exported sheets with Structured Streaming."""
