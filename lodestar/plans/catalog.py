"""The queries of the engine by name, and the SQL that each is held against."""

from __future__ import annotations

from . import extraction_queries, graph_queries, text_queries, upkeep_queries, wording_queries

FLAGSHIP = "search_topk"
QUERIES = text_queries.QUERIES | graph_queries.QUERIES | extraction_queries.QUERIES | wording_queries.QUERIES | upkeep_queries.QUERIES
SQL = text_queries.SQL | graph_queries.SQL | extraction_queries.SQL | wording_queries.SQL | upkeep_queries.SQL
