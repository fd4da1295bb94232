"""Structured Streaming forms of the engine's progressive results."""
