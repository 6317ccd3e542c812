"""Granary: compact, indexed, static tables and their queries on Spark."""
