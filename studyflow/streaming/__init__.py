"""Structured Streaming forms of the learning operators."""
