"""Structured Streaming forms of the per-row pair features."""
