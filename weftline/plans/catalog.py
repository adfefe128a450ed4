"""All queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from . import change_queries, graph_queries, report_queries, retrieval_queries, text_queries

_FAMILIES = (graph_queries, text_queries, retrieval_queries, change_queries, report_queries)
QUERIES = {name: query for family in _FAMILIES for name, query in family.QUERIES.items()}
ORACLE_SQL = {name: sql for family in _FAMILIES for name, sql in family.ORACLE_SQL.items()}
