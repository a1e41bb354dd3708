"""Building, merging and reading the concept multigraph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mycelia.functions.conductance import STEP, with_conductance
from mycelia.functions.dependency import label_to_code
from mycelia.operators.numbering import dense_number
from mycelia.plans.tables import once
from mycelia.session import cut_lineage


@dataclass(frozen=True)
class Graph:
    """``nodes`` (node_id, lemma) and ``edges`` (src_id, dst_id, dep_type, repetitions, conductance, last_op, first_seen)."""

    nodes: DataFrame
    edges: DataFrame


# -- ingest ----------------------------------------------------------------------------------------
def sentences(sentence_data: DataFrame) -> DataFrame:
    """``sent_id, tokens`` of text elements with tokens; a repeated record counts once, an empty sentence is no sentence."""
    return once(sentence_data.where("elem_type = 'text' AND size(tokens) > 0").select(F.col("rec_id").alias("sent_id"), "tokens"), "sent_id")


def exploded_tokens(rows: DataFrame) -> DataFrame:
    """``sent_id, tok_idx, lemma, dep, head_offset, n_tokens``: one row per token."""
    each = rows.select("sent_id", F.size("tokens").alias("n_tokens"), F.posexplode("tokens").alias("tok_idx", "t"))
    return each.select("sent_id", "tok_idx", "t.lemma", "t.dep", "t.head_offset", "n_tokens")


def sightings(rows: DataFrame, *carried: str) -> DataFrame:
    """``sent_id, tok_idx, src, dst, dep_type`` and the ``carried`` columns: dependent and head lemma of every token whose head lies in its sentence.

    The head is looked up inside the sentence's own array, so no join is needed. A root (offset nought), a head
    outside the sentence and null lemmas give no sighting; a null offset counts as root.
    """
    head = F.get("tokens", F.col("tok_idx") + F.col("t.head_offset"))
    each = rows.select("sent_id", "tokens", *carried, F.posexplode("tokens").alias("tok_idx", "t")).where("t.head_offset <> 0 AND tok_idx + t.head_offset >= 0")
    return each.select("sent_id", "tok_idx", *carried, F.col("t.lemma").alias("src"), head["lemma"].alias("dst"), label_to_code(F.col("t.dep")).alias("dep_type")).where("src IS NOT NULL AND dst IS NOT NULL")


def clock(rows: DataFrame) -> DataFrame:
    """``sent_id, op_seq``: the logical clock, one tick per sentence in the order of their ids, from 1."""
    return dense_number(rows.select("sent_id"), ["sent_id"], "op_seq", start=1)


def vocabulary(rows: DataFrame) -> DataFrame:
    """``node_id, lemma``: dense ids from 0 in the order of first occurrence. Lemmas count byte for byte; the empty one is a lemma."""
    first = exploded_tokens(rows).where("lemma IS NOT NULL").groupBy("lemma").agg(F.min(F.struct("sent_id", "tok_idx")).alias("at"))
    return dense_number(first.select("lemma", "at.sent_id", "at.tok_idx"), ["sent_id", "tok_idx"], "node_id").select("node_id", "lemma")


def ticked(rows: DataFrame) -> DataFrame:
    """``sent_id, tokens, op_seq``, written out: de-duplication and clock are done once for all that reads it. A repeated ``sent_id`` counts once."""
    rows = rows.dropDuplicates(["sent_id"])
    return cut_lineage(rows.join(clock(rows), "sent_id"))


def lemma_edges(rows: DataFrame, ticks: DataFrame | None = None) -> DataFrame:
    """``src, dst, dep_type, repetitions, last_op, first_seen`` by lemma: sightings folded per edge before ids are known.

    ``rows`` carry their tick (``op_seq``) or meet it in ``ticks``, which has one row per ``sent_id``.
    """
    timed = rows if ticks is None else rows.join(ticks, "sent_id")
    seen = sightings(timed, "op_seq")
    order = F.col("op_seq") * F.lit(1 << 20) + F.col("tok_idx")
    return seen.groupBy("src", "dst", "dep_type").agg(F.count(F.lit(1)).alias("repetitions"), F.max("op_seq").alias("last_op"), F.min(order).alias("first_seen"))


def with_ids(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Lemma edges with node ids; the folded edges are joined, not the sightings, so hubs weigh little."""
    src, dst = nodes.select(F.col("node_id").alias("src_id"), F.col("lemma").alias("src")), nodes.select(F.col("node_id").alias("dst_id"), F.col("lemma").alias("dst"))
    return edges.join(src, "src").join(dst, "dst").drop("src", "dst")


def build(rows: DataFrame) -> Graph:
    """The graph of all sentences of ``rows`` (``sent_id, tokens``)."""
    rows = ticked(rows)
    nodes = vocabulary(rows)
    edges = with_conductance(with_ids(lemma_edges(rows), nodes))
    return Graph(nodes, edges.select("src_id", "dst_id", "dep_type", "repetitions", "conductance", "last_op", "first_seen"))


def merge_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two edge tables by lemma folded into one: counts add up, the latest tick and the first sighting stay."""
    return old.unionByName(new).groupBy("src", "dst", "dep_type").agg(F.sum("repetitions").alias("repetitions"), F.max("last_op").alias("last_op"), F.min("first_seen").alias("first_seen"))


def merge_nodes(old: DataFrame, lemmas: DataFrame) -> DataFrame:
    """``old`` nodes and the new ones of ``lemmas`` (lemma, first_seen), numbered after the greatest old id."""
    fresh = lemmas.join(old, "lemma", "left_anti").groupBy("lemma").agg(F.min("first_seen").alias("first_seen"))
    greatest = old.agg(F.coalesce(F.max("node_id"), F.lit(-1))).first()[0]
    return old.unionByName(dense_number(fresh, ["first_seen", "lemma"], "node_id", start=greatest + 1).select("node_id", "lemma"))


def stored(graph_node: DataFrame, graph_edge: DataFrame) -> Graph:
    """The graph kept in tables: one row per batch in which an edge was seen, folded per edge.

    A null counter is one sighting, a null type is 0; rows without a target or source take no part. The strength is the
    one stored with the latest batch (by op, then edge id); a null one is that of a first sighting.
    """
    key = ["src_id", "dst_id", "dep_type"]
    rows = graph_edge.where("to_node_id >= 0 AND from_node_id IS NOT NULL AND edge_id IS NOT NULL").select(
        "edge_id", F.col("from_node_id").alias("src_id"), F.col("to_node_id").alias("dst_id"), F.coalesce("dep_type", F.lit(0)).alias("dep_type"), "repetition_counter", "last_activated_op_count", "conductance"
    )
    rows = rows.repartition(*key).dropDuplicates(["edge_id", *key])  # the rows of an edge and their copies meet in one exchange
    edges = rows.groupBy(*key).agg(
        F.sum(F.greatest(F.coalesce("repetition_counter", F.lit(1)), F.lit(1))).alias("repetitions"),
        F.max(F.struct(F.coalesce("last_activated_op_count", F.lit(-1)).alias("op"), "edge_id", F.coalesce("conductance", F.lit(STEP)).alias("g"))).alias("latest"),
        F.max("last_activated_op_count").alias("last_op"),
        F.min("edge_id").alias("first_seen"),
    )
    edges = edges.select("src_id", "dst_id", "dep_type", "repetitions", F.col("latest.g").alias("conductance"), "last_op", "first_seen")
    return Graph(once(graph_node.select("node_id", "lemma"), "node_id"), edges)


# -- reading ---------------------------------------------------------------------------------------
def stats(graph: Graph) -> DataFrame:
    """``node_count, total_edge_count``, one row."""
    parts = graph.nodes.agg(F.count(F.lit(1)).alias("n")).select(F.col("n").alias("node_count"), F.lit(0).cast("long").alias("total_edge_count"))
    edges = graph.edges.agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).cast("long").alias("node_count"), F.col("n").alias("total_edge_count"))
    return parts.unionAll(edges).agg(F.sum("node_count").alias("node_count"), F.sum("total_edge_count").alias("total_edge_count"))


def build_stats(rows: DataFrame) -> DataFrame:
    """:func:`stats` of the graph that ``rows`` would build, without building it: distinct lemmas and distinct edges are counted."""
    lemmas = exploded_tokens(rows).where("lemma IS NOT NULL").select("lemma").distinct()
    edges = sightings(rows).select("src", "dst", "dep_type").distinct()
    return stats(Graph(lemmas, edges))


def node_ids(lemmas: DataFrame, nodes: DataFrame) -> DataFrame:
    """``lemmas`` with ``node_id``; -1 where there is no such node."""
    return lemmas.join(nodes, "lemma", "left").withColumn("node_id", F.coalesce("node_id", F.lit(-1).cast("long")))


def lemmas_of(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """``ids`` (``node_id``) with ``lemma``; null where there is no such node."""
    return ids.join(nodes, "node_id", "left")


def out_degrees(graph: Graph) -> DataFrame:
    """``node_id, out_degree`` of every node, 0 without edges."""
    degree = graph.edges.groupBy(F.col("src_id").alias("node_id")).agg(F.count(F.lit(1)).alias("out_degree"))
    return graph.nodes.join(degree, "node_id", "left").select("node_id", F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def weight_shares(edges: DataFrame) -> DataFrame:
    """``src_id, dst_id, weight``: each edge's share of its source's conductance.

    The totals are folded per source and joined back, so a hub's edges need not meet in one task.
    """
    totals = edges.groupBy("src_id").agg(F.sum("conductance").alias("total"))
    return edges.join(totals, "src_id").select("src_id", "dst_id", "dep_type", (F.col("conductance") / F.col("total")).alias("weight"))
