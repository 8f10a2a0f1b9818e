"""Structured Streaming forms of live arrival."""
