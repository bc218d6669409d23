"""Incremental variants of batch operators on Structured Streaming."""
