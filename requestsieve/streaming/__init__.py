"""Structured Streaming forms of the cascade and the analytics."""
