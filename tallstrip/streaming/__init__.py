"""Streaming forms of batch plans."""
