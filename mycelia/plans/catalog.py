"""All queries outside the text-corpus subpackage."""

from __future__ import annotations

from mycelia.plans import graph_queries, hub_queries, more_queries

_PARTS = (hub_queries, graph_queries, more_queries)
QUERIES = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
SQL = {k: v for p in _PARTS for k, v in p.SQL.items()}
FLAGSHIP = "render_answer"
