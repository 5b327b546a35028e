"""Structured Streaming forms of the log operators and idempotent sinks."""
