"""Incremental versions of the loads, on Structured Streaming."""
