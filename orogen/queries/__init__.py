"""Registered queries: each module has QUERIES (name: function of spark and folder) and SQL (name: DuckDB text)."""
