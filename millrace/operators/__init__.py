"""Relational operators: joins, aggregates, windows, reshaping and set operations."""
