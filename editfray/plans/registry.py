"""All queries of the library but the optional ones, and their SQL."""

from __future__ import annotations

from . import history_queries, live_queries, more_queries, served_queries, source_queries

_MODULES = (history_queries, live_queries, more_queries, source_queries, served_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
