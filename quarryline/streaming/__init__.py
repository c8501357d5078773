"""Incremental forms of the operators with Structured Streaming."""
