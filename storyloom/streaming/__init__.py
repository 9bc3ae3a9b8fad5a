"""Structured Streaming forms of the polled surfaces."""
