"""Documented capabilities with a plain relational meaning: rules, emergence, history, recall, curriculum, quality."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mycelia.operators.graph import Graph
from mycelia.session import cut_lineage

FACT = ["src", "relation", "dst"]


def closure(facts: DataFrame, transitive: list[str], inherited: list[tuple[str, str]] | None = None, symmetric: list[str] | None = None, within: list[str] | None = None) -> DataFrame:
    """``src, relation, dst, depth``: facts and all that follows from them, by rounds until nothing is new.

    ``transitive`` relations chain with themselves; ``(a, b)`` in ``inherited`` lets ``x a y`` and ``y b z`` give ``x b z``;
    ``symmetric`` ones, given or derived, are turned round. Only facts new in the last round are joined (semi-naive), each keeps its least depth.
    A cycle gives facts of a node with itself. ``within`` names columns that stay the same along a derivation (a source, a module) and are returned too.
    """
    keys = [*(within or []), *FACT]
    rules = [(r, r) for r in transitive] + list(inherited or [])

    def turned(df: DataFrame) -> DataFrame:
        if not symmetric:
            return df
        back = df.where(F.col("relation").isin(symmetric)).select(*(within or []), F.col("dst").alias("src"), "relation", F.col("src").alias("dst"))
        return df.unionByName(back)

    base = turned(facts.select(*keys).where("src IS NOT NULL AND relation IS NOT NULL AND dst IS NOT NULL"))
    known = cut_lineage(base.distinct().withColumn("depth", F.lit(0)))
    new, k = known, 0
    while rules:  # ends: there are finitely many facts over the nodes given, and every round adds one
        k += 1
        on = [*(within or []), "mid"]
        steps = []
        for first, second in rules:
            left = lambda df, r=first: df.where(F.col("relation") == r).select(*(within or []), "src", F.col("dst").alias("mid"))
            right = lambda df, r=second: df.where(F.col("relation") == r).select(*(within or []), F.col("src").alias("mid"), "relation", "dst")
            steps += [left(new).join(right(known), on), left(known).join(right(new), on)]
        derived = turned(reduce(DataFrame.unionByName, steps).select(*keys)).distinct()
        new = cut_lineage(derived.join(known, keys, "left_anti").withColumn("depth", F.lit(k)))
        if new.isEmpty():
            break
        known = cut_lineage(known.unionByName(new))
    return known


def emergence(facts: DataFrame, transitive: list[str]) -> DataFrame:
    """``src, relation, dst`` that follow from all sources together but from none alone (``facts`` has ``source``), for any number of sources."""
    alone = closure(facts.where("source IS NOT NULL"), transitive, within=["source"]).select(*FACT).distinct()
    return closure(facts, transitive).select(*FACT).join(alone, FACT, "left_anti")


def history(sightings: DataFrame, subject: list[str], value: str, at: str, order: str) -> DataFrame:
    """Functional facts in time: each value of a subject holds until the next one supersedes it (``valid_from``, ``valid_to``)."""
    w = Window.partitionBy(*subject).orderBy(at, order)
    changed = sightings.withColumn("_prev", F.lag(value).over(w)).where(~F.col(value).eqNullSafe(F.col("_prev")) | F.col("_prev").isNull())
    return changed.select(*subject, value, F.col(at).alias("valid_from"), F.lead(at).over(w).alias("valid_to"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 2048) -> DataFrame:
    """``query_id, vec_id, score, rank``: the ``k`` most similar vectors by cosine, every query against every row in blocks.

    Queries are cut into blocks of ``block``; each block passes over all rows by matrix products and keeps its best per task, so
    what a task holds and emits is bounded by the block. Null or zero vectors take no part; ties go to the smaller id.
    """
    ids = queries.where("embedding IS NOT NULL").select("vec_id")
    out = None
    n = ids.count()
    ordered = queries.where("embedding IS NOT NULL").withColumn("_b", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-n // block)))))
    for b in range(max(1, -(-n // block))):
        chosen = ordered.where(F.col("_b") == b).select("vec_id", "embedding").collect()
        if not chosen:
            continue
        q_ids = np.array([r.vec_id for r in chosen])
        q = np.array([r.embedding for r in chosen], np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-30)

        def run(batches: Iterator[pd.DataFrame], q_ids=q_ids, q=q) -> Iterator[pd.DataFrame]:
            for batch in batches:
                m = np.stack(batch["embedding"].to_numpy()).astype(np.float64)
                norm = np.linalg.norm(m, axis=1, keepdims=True)
                v_ids = batch["vec_id"].to_numpy()
                scores = np.round(q @ (m / np.maximum(norm, 1e-30)).T, 6)
                scores[:, norm[:, 0] == 0] = -2
                scores[q_ids[:, None] == v_ids[None, :]] = -2
                top = np.lexsort((np.broadcast_to(v_ids, scores.shape), -scores), axis=1)[:, :k]
                rows = np.repeat(np.arange(len(q_ids)), top.shape[1])
                flat = top.ravel()
                keep = scores[rows, flat] > -2
                yield pd.DataFrame({"query_id": q_ids[rows][keep], "vec_id": v_ids[flat][keep], "score": scores[rows, flat][keep]})

        part = vectors.where("embedding IS NOT NULL").select("vec_id", "embedding").mapInPandas(run, "query_id bigint, vec_id bigint, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, vec_id bigint, score double, rank int")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def levels(edges: DataFrame) -> DataFrame:
    """``node, level``: a learning order, every node after all it depends on (``src`` depends on ``dst``); nodes on or behind cycles have none."""
    rest = cut_lineage(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct())
    todo = cut_lineage(edges.select(F.explode(F.array("src", "dst")).alias("node")).where("node IS NOT NULL").distinct())
    done, k = todo.withColumn("level", F.lit(0)).limit(0), 0
    while True:  # ends: every round takes nodes out
        free = cut_lineage(todo.join(rest.select(F.col("src").alias("node")).distinct(), "node", "left_anti").withColumn("level", F.lit(k)))
        if free.isEmpty():
            return done
        done = cut_lineage(done.unionByName(free))
        todo = cut_lineage(todo.join(free, "node", "left_anti"))
        rest = cut_lineage(rest.join(free.select(F.col("node").alias("dst")), "dst", "left_anti"))
        k += 1


def relation_entropy(edges: DataFrame) -> DataFrame:
    """``relations, entropy``: how evenly edges are spread over relation types, in nats."""
    per = edges.groupBy("dep_type").agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n").alias("s")).first()[0] or 1
    p = F.col("n") / F.lit(float(total))
    return per.agg(F.count(F.lit(1)).alias("relations"), F.round(-F.sum(p * F.log(p)), 9).alias("entropy"))


def canonical(nodes: DataFrame) -> DataFrame:
    """``node_id, canonical_id``: nodes whose lemmas differ only in case share the smallest id."""
    least = nodes.groupBy(F.lower("lemma").alias("key")).agg(F.min("node_id").alias("canonical_id"))
    return nodes.where("lemma IS NOT NULL").withColumn("key", F.lower("lemma")).join(least, "key").select("node_id", "canonical_id")


def routed(words: DataFrame, topic_words: DataFrame, k: int = 3) -> DataFrame:
    """``query_id, topic, overlap, rank``: the ``k`` topics that share most distinct words with a question."""
    met = words.select("query_id", "lemma").distinct().join(topic_words.select("topic", "lemma").distinct(), "lemma")
    counted = met.groupBy("query_id", "topic").agg(F.count(F.lit(1)).alias("overlap"))
    w = Window.partitionBy("query_id").orderBy(F.desc("overlap"), "topic")
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def corroborated(sightings: DataFrame, fact: list[str], source: str) -> DataFrame:
    """``fact`` columns with ``sightings`` and ``sources``: how often a fact was seen and how many different sources bear it out (null ones do not)."""
    per = sightings.groupBy(*fact, source).agg(F.count(F.lit(1)).alias("n"))  # folded per source first: a hub fact is a few rows when it is counted
    return per.groupBy(*fact).agg(F.sum("n").alias("sightings"), F.count(source).alias("sources"))


def quality(graph: Graph) -> DataFrame:
    """One row on connectivity and consistency: ``nodes, edges``, ``isolated`` nodes without an edge, ``loops``, ``mutual`` pairs joined both ways, and ``dangling`` ends that are no node."""
    ends = graph.edges.select(F.explode(F.array("src_id", "dst_id")).alias("node_id")).distinct()
    both = graph.nodes.select("node_id", F.lit(True).alias("node")).join(ends.withColumn("end", F.lit(True)), "node_id", "full")
    nodes = both.agg(F.count("node").alias("nodes"), F.count_if(F.col("end").isNull()).alias("isolated"), F.count_if(F.col("node").isNull()).alias("dangling"))
    # a pair joined both ways meets itself under its ordered ends
    pairs = graph.edges.groupBy(F.least("src_id", "dst_id").alias("a"), F.greatest("src_id", "dst_id").alias("b")).agg(F.count_distinct("src_id").alias("ways"), F.count(F.lit(1)).alias("n"))
    edges = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edges"), F.count_if(F.col("a") == F.col("b")).alias("loops"), F.count_if(F.col("ways") == 2).alias("mutual"))
    columns = ["nodes", "edges", "isolated", "loops", "mutual", "dangling"]
    parts = nodes.unionByName(edges, allowMissingColumns=True)
    return parts.agg(*[F.max(c).alias(c) for c in columns])
