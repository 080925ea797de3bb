"""Structured Streaming over triples."""
