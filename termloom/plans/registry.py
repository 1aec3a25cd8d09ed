"""All queries of the core, and their SQL where SQL can express them."""

from __future__ import annotations

from termloom.plans import array_queries, graph_queries, io_queries, search_queries, skew_queries, source_queries, split_queries, text_queries

MODULES = (
    skew_queries, graph_queries, text_queries, split_queries, array_queries, search_queries, source_queries, io_queries
)
QUERIES = {k: q for m in MODULES for k, q in m.QUERIES.items()}
SQL = {k: q for m in MODULES for k, q in m.SQL.items()}
