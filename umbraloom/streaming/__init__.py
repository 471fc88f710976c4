"""Incremental forms of batch operators with Structured Streaming."""
