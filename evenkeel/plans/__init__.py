"""Operators put together, and the queries over the test tables."""
