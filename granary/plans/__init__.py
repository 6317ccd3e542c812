"""Stored tables and the query registry."""
