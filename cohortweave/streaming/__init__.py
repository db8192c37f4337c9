"""Structured Streaming forms of the log, rating, scoring and verdict operators."""
