"""Incremental forms of the batch steps (Structured Streaming)."""
