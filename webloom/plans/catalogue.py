"""All queries of the library by name, and the SQL that DuckDB checks them with."""

from __future__ import annotations

from webloom.plans import adapter_queries, index_queries, sql_queries, stream_queries, table_queries, text_queries

_PARTS = [text_queries, table_queries, index_queries, stream_queries, adapter_queries, sql_queries]

QUERIES = {name: run for part in _PARTS for name, run in part.R.queries.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.R.sql.items()}
