"""Composite queries, the query registry and the DuckDB oracle text."""
