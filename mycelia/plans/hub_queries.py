"""Queries of the hot-key problem and their SQL."""

from __future__ import annotations

from mycelia.operators.hotkeys import hub_report
from mycelia.plans.tables import table

QUERIES = {"p3_found": lambda spark, d: hub_report(table(spark, d, "graph_edge"), table(spark, d, "graph_node"))}

SQL = {
    "p3_found": """
WITH e AS (SELECT DISTINCT edge_id, from_node_id, to_node_id, coalesce(dep_type, 0) AS dep_type,
                  coalesce(repetition_counter, 0) AS n
           FROM graph_edge WHERE to_node_id >= 0),
s AS (SELECT from_node_id, to_node_id, dep_type, sum(n) AS strength FROM e GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY to_node_id ORDER BY strength DESC, from_node_id, dep_type) AS k FROM s),
o AS (SELECT from_node_id, count(*) AS outs FROM s GROUP BY 1),
g AS (SELECT DISTINCT node_id, edge_count FROM graph_node)
SELECT to_node_id AS node_id, 'in' AS kind, from_node_id, dep_type FROM r WHERE k = 1
UNION ALL
SELECT node_id, 'count', -1::BIGINT, -1::INT FROM g LEFT JOIN o ON o.from_node_id = g.node_id
WHERE edge_count IS NULL OR edge_count <> coalesce(outs, 0)
"""
}
