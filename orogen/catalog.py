"""The registered terrain queries and their DuckDB equivalents."""

from __future__ import annotations

from .queries import documents, shapes, stores, terrain

MODULES = (terrain, shapes, documents, stores)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
