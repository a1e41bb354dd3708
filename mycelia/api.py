"""The graph as an object: one session's graph and activation, in the calls users know.

Each call is a plan over DataFrames; what it returns is small by nature (a count, an id, a cut list) or meant to be read. For
many questions at once use :func:`mycelia.operators.answers.run_queries`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mycelia.operators import activation as A
from mycelia.operators import answers as Q
from mycelia.operators import graph as G
from mycelia.plans import store
from mycelia.schemas import TOKEN
from mycelia.session import cut_lineage

OK, BAD_ARGUMENT, OUT_OF_RANGE = 0, -1, -2
_EMPTY_EDGES = "src string, dst string, dep_type int, repetitions bigint, last_op bigint, first_seen bigint"


class ConceptGraph:
    """Opens empty, on a :class:`Graph`, or on stored modules; opening twice keeps what is there."""

    def __init__(self, spark: SparkSession, graph: G.Graph | None = None):
        self.spark, self._open = spark, False
        self._given = graph
        self._transitions: tuple[G.Graph, DataFrame] | None = None
        self.connect()

    # -- session -------------------------------------------------------------------------------
    def connect(self) -> None:
        if self._open:
            return
        self._open, self._clock = True, 0
        self._nodes = self._given.nodes if self._given else self.spark.createDataFrame([], "node_id bigint, lemma string")
        if self._given:
            names = self._nodes.select("node_id", "lemma")
            src, dst = names.toDF("src_id", "src"), names.toDF("dst_id", "dst")
            self._edges = self._given.edges.join(src, "src_id").join(dst, "dst_id").select("src", "dst", "dep_type", "repetitions", "last_op", "first_seen")
            self._clock = self._edges.agg(F.max("last_op")).first()[0] or 0
        else:
            self._edges = self.spark.createDataFrame([], _EMPTY_EDGES)
        self.reset_activations()

    def disconnect(self) -> None:
        self._open = False

    def is_connected(self) -> bool:
        return self._open

    def __enter__(self) -> ConceptGraph:
        self.connect()
        return self

    def __exit__(self, *_: object) -> None:
        self.disconnect()

    def _check(self) -> None:
        if not self._open:
            raise ConnectionError("the graph is closed")

    # -- building ------------------------------------------------------------------------------
    def ingest_sentence(self, tokens: list[dict]) -> int:
        return self.ingest_sentences([tokens])

    def ingest_sentences(self, batch: list[list[dict]]) -> int:
        """Fold a batch of token lists in, all or nothing; empty ones do not move the clock."""
        self._check()
        rows = [(self._clock + i + 1, [(t["lemma"], t["dep"], t["head_offset"]) for t in s]) for i, s in enumerate(s for s in batch if s)]
        if rows:
            self.ingest(self.spark.createDataFrame(rows, f"sent_id bigint, tokens array<{TOKEN.simpleString()}>"), len(rows))
        return OK

    def ingest(self, sentences: DataFrame, count: int | None = None) -> None:
        """Fold a table of sentences (``sent_id``, ``tokens``) in, in the order of their ids; a repeated id is a repeated record and counts once."""
        sentences = G.ticked(sentences).withColumn("op_seq", F.col("op_seq") + self._clock)
        new = G.lemma_edges(sentences)
        each = sentences.select("op_seq", F.posexplode("tokens").alias("tok_idx", "t")).where("t.lemma IS NOT NULL")
        lemmas = each.select("t.lemma", (F.col("op_seq") * F.lit(1 << 20) + F.col("tok_idx")).alias("first_seen"))
        self._nodes = cut_lineage(G.merge_nodes(self._nodes, lemmas))
        self._edges = cut_lineage(G.merge_edges(self._edges, new))
        self._clock += count if count is not None else sentences.count()
        self._graph = None

    @property
    def graph(self) -> G.Graph:
        if getattr(self, "_graph", None) is None:
            edges = G.with_conductance(G.with_ids(self._edges, self._nodes))
            self._graph = G.Graph(self._nodes, cut_lineage(edges.select("src_id", "dst_id", "dep_type", "repetitions", "conductance", "last_op", "first_seen")))
        return self._graph

    def save(self, folder: str, module: str) -> None:
        store.save(self.graph, folder, module)

    # -- reading -------------------------------------------------------------------------------
    def get_stats(self) -> dict:
        self._check()
        return G.stats(self.graph).first().asDict()

    def get_node_id(self, lemma: str) -> int:
        self._check()
        row = self._nodes.where(F.col("lemma") == lemma).first()
        return row.node_id if row else -1

    def get_lemma_by_id(self, node_id: int) -> str | None:
        self._check()
        row = self._nodes.where(F.col("node_id") == node_id).first()
        return row.lemma if row else None

    # -- activation ----------------------------------------------------------------------------
    def reset_activations(self) -> None:
        self._active = self.spark.createDataFrame([], "query_id bigint, node_id bigint, activation double")

    def set_activation(self, node_id: int, value: float) -> int:
        self._check()
        if self.get_lemma_by_id(node_id) is None:
            return OUT_OF_RANGE
        one = self.spark.createDataFrame([(0, node_id, float(value))], "query_id bigint, node_id bigint, activation double")
        self._active = cut_lineage(self._active.where(F.col("node_id") != node_id).unionByName(one))
        return OK

    def spread_activation_step(self, anchors: list[int]) -> None:
        """One step; anchors that are no node are ignored."""
        self._check()
        given = self.spark.createDataFrame([(0, a) for a in sorted(set(anchors))], "query_id bigint, node_id bigint").join(self._nodes, "node_id", "left_semi").select("query_id", "node_id")
        self._active = cut_lineage(A.spread_step(self._active, given, self._moves()))

    def _moves(self) -> DataFrame:
        """The transitions of the present graph, made once for all steps."""
        if self._transitions is None or self._transitions[0] is not self.graph:
            self._transitions = (self.graph, A.transitions(A.normalised(self.graph.edges)))
        return self._transitions[1]

    def get_significant_nodes(self, compat: bool = False) -> list[dict]:
        self._check()
        kept = (A.significant_padded if compat else A.significant)(self._active)
        rows = kept.join(self._nodes, "node_id", "left").orderBy("rn").select(F.col("node_id").alias("id"), "lemma", "activation").collect()
        return [r.asDict() for r in rows]

    def get_subgraph_edges(self, node_ids: list[int]) -> list[dict]:
        self._check()
        wanted = self.spark.createDataFrame([(0, n, i) for i, n in enumerate(node_ids)], "query_id bigint, node_id bigint, rn int")
        found = A.capped(A.subgraph(wanted, self.graph.edges), max(1, self.get_stats()["total_edge_count"]))
        return [r.asDict() for r in found.orderBy("rn", "first_seen").select("from_id", "to_id", "dep_type", "conductance").collect()]

    def run_query(self, text: str, steps: int = 3, direction: str = "out", compat: bool = False) -> str:
        """The prompt for one question."""
        self._check()
        asked = self.spark.createDataFrame([(0, text)], "query_id bigint, query string")
        return Q.run_queries(self.graph, asked, steps, direction, compat).first().answer
