"""Structured Streaming forms of the period aggregates."""
