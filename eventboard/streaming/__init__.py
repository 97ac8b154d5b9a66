"""Structured Streaming forms of freshness and of the last-known-good table."""
