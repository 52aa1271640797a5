"""Every query of the engine by name, with its DuckDB oracle where SQL can express it."""

from __future__ import annotations

from . import page_queries, store_queries, vector_queries

QUERIES = page_queries.QUERIES | vector_queries.QUERIES | store_queries.QUERIES
SQL = page_queries.SQL | vector_queries.SQL | store_queries.SQL
