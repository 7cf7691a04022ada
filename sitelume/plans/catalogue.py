"""Every registered query with its oracle SQL."""

from __future__ import annotations

from . import crawl_queries, run_queries, site_queries, stream_queries
from .registry import Query

_ALL = [crawl_queries.R, site_queries.R, stream_queries.R, run_queries.R]
QUERIES: dict[str, Query] = {name: query for r in _ALL for name, query in r.queries.items()}
ORACLE_SQL: dict[str, str] = {name: sql for r in _ALL for name, sql in r.oracle.items()}
