"""A graph in Parquet, one folder per module, so that modules are mounted and left out by partition."""

from __future__ import annotations

import hashlib
import os
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mycelia.functions.conductance import with_conductance
from mycelia.operators.graph import Graph


def save(graph: Graph, folder: str, module: str) -> None:
    """Write one module; its edges carry lemmas, so modules with different ids can be mounted together."""
    src, dst = graph.nodes.select(F.col("node_id").alias("src_id"), F.col("lemma").alias("src")), graph.nodes.select(F.col("node_id").alias("dst_id"), F.col("lemma").alias("dst"))
    edges = graph.edges.join(src, "src_id").join(dst, "dst_id").select("src", "dst", "dep_type", "repetitions", "last_op", "first_seen")
    graph.nodes.write.mode("overwrite").parquet(f"{folder}/nodes/module={module}")
    edges.write.mode("overwrite").parquet(f"{folder}/edges/module={module}")


def new_module(spark: SparkSession, folder: str, path: str) -> str:
    """A name for what is ingested from ``path`` now: told by the whole path, and by its turn if it was ingested before, so that nothing is replaced."""
    whole = os.path.abspath(path)
    name = re.sub(r"\W", "_", os.path.basename(whole)) + "_" + hashlib.sha256(whole.encode()).hexdigest()[:8]
    try:
        taken = sum(r.module.rpartition("-")[0] == name for r in modules(spark, folder).collect())
    except AnalysisException:  # nothing stored yet
        taken = 0
    return f"{name}-{taken + 1}"


def modules(spark: SparkSession, folder: str) -> DataFrame:
    """``module, edges`` of what is stored."""
    return spark.read.parquet(f"{folder}/edges").groupBy("module").agg(F.count(F.lit(1)).alias("edges"))


def mount(spark: SparkSession, folder: str, names: list[str]) -> Graph:
    """The graph of the named modules: ids anew by lemma, edges seen in several modules folded into one."""
    from mycelia.operators.numbering import dense_number

    nodes = spark.read.parquet(f"{folder}/nodes").where(F.col("module").isin(names)).select("lemma").distinct()
    nodes = dense_number(nodes, ["lemma"], "node_id").select("node_id", "lemma")
    rows = spark.read.parquet(f"{folder}/edges").where(F.col("module").isin(names))
    folded = rows.groupBy("src", "dst", "dep_type").agg(F.sum("repetitions").alias("repetitions"), F.max("last_op").alias("last_op"), F.min("first_seen").alias("first_seen"))
    src, dst = nodes.select(F.col("node_id").alias("src_id"), F.col("lemma").alias("src")), nodes.select(F.col("node_id").alias("dst_id"), F.col("lemma").alias("dst"))
    edges = with_conductance(folded.join(src, "src").join(dst, "dst"))
    return Graph(nodes, edges.select("src_id", "dst_id", "dep_type", "repetitions", "conductance", "last_op", "first_seen"))
