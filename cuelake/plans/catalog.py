"""All registered queries of the library and their SQL."""

from __future__ import annotations

from . import media_queries, merge_queries, ops_queries, quality_queries, rule_queries, translation_queries

_PARTS = (merge_queries, quality_queries, rule_queries, translation_queries, media_queries, ops_queries)
QUERIES = {name: query for part in _PARTS for name, (query, _) in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, (_, sql) in part.QUERIES.items() if sql}
