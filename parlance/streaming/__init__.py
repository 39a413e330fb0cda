"""Structured Streaming and stateful operators."""
