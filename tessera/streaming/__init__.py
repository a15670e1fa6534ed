"""Structured Streaming over logs."""
