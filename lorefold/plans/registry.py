"""The registered queries over the driver's tables and the SQL that they equal."""

from __future__ import annotations

from . import content_queries, operation_queries, search_queries, service_queries

_PARTS = (search_queries, content_queries, operation_queries, service_queries)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
