"""Incremental forms of the boards on Structured Streaming."""
