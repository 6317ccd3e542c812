"""Operators on tables: row ids, key access, indexes, encodings, statistics, verification."""
