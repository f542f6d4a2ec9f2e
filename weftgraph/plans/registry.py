"""All registered queries and their SQL twins."""

from __future__ import annotations

from . import attach_queries, catalog_queries, function_queries, graph_queries, issue_queries, record_queries, report_queries, search_queries, stream_queries, table_queries, text_queries, view_queries

MODULES = (graph_queries, text_queries, table_queries, attach_queries, function_queries, view_queries, catalog_queries, issue_queries, report_queries, record_queries, search_queries, stream_queries)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE: dict[str, str] = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
