"""All queries of the core engine and their SQL."""

from __future__ import annotations

from staylens.plans import evaluation_queries, io_queries, search_queries, text_queries

QUERIES = text_queries.QUERIES | search_queries.QUERIES | evaluation_queries.QUERIES | io_queries.QUERIES
ORACLE = text_queries.ORACLE | search_queries.ORACLE | evaluation_queries.ORACLE | io_queries.ORACLE
FLAGSHIP = search_queries.hybrid_search
