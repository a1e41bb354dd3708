"""Per-key results when a few keys hold most rows: eager aggregation through joins.

Both inputs are folded to one compact state per join key before they meet, so the join sees at
most one row per key from either side and the work of a hub is spread over the map side:

1. edge rows -> distinct ``edge_id``s (the shuffle key is unique, hence even);
2. distinct rows -> one state per (to, from, dep), map-side combined;
3. each state is sent to both its ends as a partial state (best in-edge, one out-edge) and folded
   per node, again map-side combined: a hub contributes at most one partial state per task;
4. node states meet node rows in one equi-join on ``node_id`` and are rolled up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edge_states(edges: DataFrame) -> DataFrame:
    """``from_node_id, to_node_id, dep_type, strength``: one row per distinct edge.

    Rows with a null or negative ``to_node_id`` or a null ``from_node_id`` or ``edge_id`` take no part;
    a null ``dep_type`` is 0, a null ``repetition_counter`` is 0; a repeated ``edge_id`` counts once.
    """
    rows = (
        edges.where("to_node_id >= 0 AND from_node_id IS NOT NULL AND edge_id IS NOT NULL")
        .select(
            "edge_id",
            "from_node_id",
            "to_node_id",
            F.coalesce("dep_type", F.lit(0)).alias("dep_type"),
            F.coalesce("repetition_counter", F.lit(0).cast("long")).alias("n"),
        )
        .groupBy("edge_id")
        .agg(*[F.first(c).alias(c) for c in ("from_node_id", "to_node_id", "dep_type", "n")])
    )
    return rows.groupBy("from_node_id", "to_node_id", "dep_type").agg(F.sum("n").alias("strength"))


def node_states(states: DataFrame) -> DataFrame:
    """``node_id, best, out_degree``: the strongest in-edge (null if none) and the number of distinct out-edges."""
    none = "CAST(NULL AS STRUCT<loss: BIGINT, from_node_id: BIGINT, dep_type: INT>)"
    ends = states.select(
        F.expr(
            f"""inline(array(
              struct(to_node_id AS node_id, struct(-strength AS loss, from_node_id, dep_type) AS best, 0L AS outs),
              struct(from_node_id AS node_id, {none} AS best, 1L AS outs)))"""
        )
    )
    # the least (-strength, from, dep) is the greatest strength with ties to the smaller from, then dep
    return ends.groupBy("node_id").agg(F.min("best").alias("best"), F.sum("outs").alias("out_degree"))


def hub_report(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node_id, kind, from_node_id, dep_type``.

    ``in``: the strongest in-edge of every target node. ``count`` (with -1, -1): nodes whose stored
    ``edge_count`` is null or differs from the distinct out-edges found. A repeated node row counts
    once; rows with a null ``node_id`` are left out; empty inputs give an empty result.
    """
    stored = (
        nodes.where("node_id IS NOT NULL")
        .groupBy("node_id")
        .agg(F.first("edge_count").alias("edge_count"), F.lit(True).alias("stored"))
    )
    both = node_states(edge_states(edges)).join(stored, "node_id", "full")
    stale = "stored AND (edge_count IS NULL OR edge_count <> coalesce(out_degree, 0L))"
    return both.select(
        "node_id",
        F.expr(
            f"""inline(filter(array(
              IF(best IS NOT NULL, struct('in' AS kind, best.from_node_id AS from_node_id, best.dep_type AS dep_type), NULL),
              IF({stale}, struct('count' AS kind, -1L AS from_node_id, -1 AS dep_type), NULL)), x -> x IS NOT NULL))"""
        ),
    )
