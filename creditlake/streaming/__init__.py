"""Streaming entry to the scoring path."""
