"""Structured Streaming forms of the graph aggregates."""
