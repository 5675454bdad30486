"""Typed loading of logs and tables."""
