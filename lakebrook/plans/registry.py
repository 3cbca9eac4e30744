"""All queries of the reference's own operators, by key, with the SQL that gives the same rows."""

from __future__ import annotations

from . import evaluation_queries, retrieval, source_queries, state_queries, stream_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (retrieval, state_queries, evaluation_queries, source_queries, stream_queries):
    QUERIES |= _module.q.queries
    ORACLES |= _module.q.oracles
