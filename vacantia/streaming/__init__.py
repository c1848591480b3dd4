"""Structured Streaming versions of the recurring jobs."""
