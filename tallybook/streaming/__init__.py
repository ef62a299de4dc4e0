"""Counts kept by Structured Streaming queries."""
