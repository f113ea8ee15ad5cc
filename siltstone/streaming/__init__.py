"""Structured Streaming form of the corpus build."""
