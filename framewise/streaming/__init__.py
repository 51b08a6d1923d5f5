"""Structured Streaming versions of the time operators."""
