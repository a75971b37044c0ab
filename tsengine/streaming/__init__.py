"""Structured Streaming use of the stateless expressions."""
