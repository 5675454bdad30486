"""Structured Streaming forms of the heartbeat operators."""
