"""Structured Streaming twins of the feed operators."""
