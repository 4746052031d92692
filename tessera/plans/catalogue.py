"""Every registered query of the library proper, with its SQL."""

from __future__ import annotations

from tessera.plans import attribution_queries, call_queries, check_queries, document_queries, knowledge_queries, market_queries, name_queries, series_queries, table_queries

FLAGSHIP = "nav_kpis"
_PARTS = (series_queries, attribution_queries, market_queries, name_queries, knowledge_queries, document_queries, call_queries, table_queries, check_queries)
QUERIES = {k: f for p in _PARTS for k, f in p.QUERIES.items()}
SQL = {k: s for p in _PARTS for k, s in p.SQL.items()}
if len(QUERIES) < sum(len(p.QUERIES) for p in _PARTS):
    raise ValueError("two queries have the same name")
