"""Feeds as Structured Streaming queries."""
