"""The registered queries of the document-analytics operators, by name, and their DuckDB SQL."""

from __future__ import annotations

from quirelake.plans import flow_queries, layout_queries, review_queries, source_queries, text_queries

_ALL = {**text_queries.QUERIES, **layout_queries.QUERIES, **review_queries.QUERIES, **source_queries.QUERIES, **flow_queries.QUERIES}

QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items() if sql is not None}
