"""Worked examples of graph building, activation and answers."""

import pytest
from pyspark.sql import functions as F

from mycelia.api import ConceptGraph
from mycelia.functions.conductance import folded, with_conductance
from mycelia.functions.dependency import code_to_label, label_to_code
from mycelia.functions.text import intent, not_blank, suffix
from mycelia.operators import activation as A
from mycelia.operators import answers as Q
from mycelia.operators import graph as G

tok = lambda lemma, dep, off: {"lemma": lemma, "dep": dep, "head_offset": off}
S1 = [tok("boy", "nsubj", 1), tok("sleeps", "ROOT", 0)]
S2 = [tok("tired", "amod", 1), tok("boy", "nsubj", 0)]
SENTS = "sent_id bigint, tokens array<struct<lemma:string,dep:string,head_offset:int>>"
F3 = [(0, 1, 2, 2), (0, 2, 3, 1), (0, 1, 37, 1), (1, 3, 24, 3), (2, 3, 24, 1), (3, 3, 27, 1), (4, 0, 24, 1)]


def branching(spark):
    edges = spark.createDataFrame([(*e[:3], e[3], 1, i) for i, e in enumerate(F3)], "src_id bigint, dst_id bigint, dep_type int, repetitions bigint, last_op bigint, first_seen bigint")
    nodes = spark.createDataFrame(list(enumerate("abcde")), "node_id bigint, lemma string")
    return G.Graph(nodes, with_conductance(edges))


def test_upsert_and_lookup(spark):
    g = ConceptGraph(spark)
    for s in (S1, S2, S1, []):
        assert g.ingest_sentence(s) == 0
    assert [g.get_node_id(x) for x in ("boy", "sleeps", "tired", "nonexistent")] == [0, 1, 2, -1]
    rows = {(r.src_id, r.dst_id, r.dep_type): (r.repetitions, round(r.conductance, 10), r.last_op) for r in g.graph.edges.collect()}
    assert rows == {(0, 1, 2): (2, 0.1909090909, 3), (2, 0, 24): (1, 0.1, 2)}
    assert g.get_stats() == {"node_count": 3, "total_edge_count": 2}
    assert {r.node_id: r.out_degree for r in G.out_degrees(g.graph).collect()} == {0: 1, 1: 0, 2: 1}
    assert g.get_lemma_by_id(7) is None and g.set_activation(7, 1.0) == -2
    g.disconnect()
    with pytest.raises(ConnectionError):
        g.get_stats()


def test_batch_equals_build_and_ids_follow_first_occurrence(spark):
    rows = spark.createDataFrame([(1, [tuple(t.values()) for t in S1]), (2, [tuple(t.values()) for t in S2]), (3, [tuple(t.values()) for t in S1])], SENTS)
    built = G.build(rows)
    assert sorted(map(tuple, built.nodes.collect())) == [(0, "boy"), (1, "sleeps"), (2, "tired")]
    assert {(r.src_id, r.dst_id): r.last_op for r in built.edges.collect()} == {(0, 1): 3, (2, 0): 2}


def test_edge_cases_of_sightings(spark):
    rows = spark.createDataFrame(
        [
            (1, [("a", "nsubj", 5), ("b", "nsubj", -3)]),  # heads outside
            (2, [("x", "NSUBJ", 1), ("x", "ROOT", 0)]),  # self-loop, wrongly cased label
            (3, [("a", "nsubj", 1), ("b", "dobj", -1)]),
            (4, [("a", "dobj", 1), ("b", None, None)]),  # the same pair under another type
            (5, [(None, "det", 1), ("", "det", -1)]),  # no lemma; the empty lemma is one
            (6, []),
        ],
        SENTS,
    )
    found = {(r.src, r.dst, r.dep_type) for r in G.sightings(rows).collect()}
    assert found == {("x", "x", 0), ("a", "b", 2), ("b", "a", 3), ("a", "b", 3)}
    assert {r.lemma for r in G.vocabulary(rows.where("size(tokens) > 0")).collect()} == {"a", "b", "x", ""}


def test_conductance(spark):
    counts = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 4, 5, 100, 2049, 5000)], "repetitions bigint")
    g = {r.repetitions: r.conductance for r in with_conductance(counts).collect()}
    assert g[0] is None
    for n, want in {1: 0.1, 2: 0.19090909090909092, 3: 0.2748785565579459, 4: 0.3533174003878953, 5: 0.42720989594831404, 100: 3.5994656829473657}.items():
        assert g[n] == want
    exact = {r.repetitions: r.g for r in counts.select("repetitions", folded(F.col("repetitions")).alias("g")).collect()}
    assert all(abs(g[n] - exact[n]) < 1e-6 for n in (2049, 5000))
    huge = with_conductance(spark.createDataFrame([(10**9,), (10**12,)], "repetitions bigint")).collect()
    assert [round(r.conductance / (0.2 * r.repetitions) ** 0.5, 3) for r in huge] == [1.0, 1.0]


@pytest.mark.parametrize("given, want, kept", [([0], {0: 1, 1: 1.3023256, 2: 0.4476744, 3: 3}, [3]), ([0, 4], {0: 2.75, 1: 2.7906977, 2: 0.9593023, 3: 4, 4: 1}, [3, 1, 0])])
def test_spread_and_cut(spark, given, want, kept):
    g = branching(spark)
    anchors = spark.createDataFrame([(7, a) for a in given + given], "query_id bigint, node_id bigint").distinct()
    active = A.spread(anchors, A.normalised(g.edges))
    assert {r.node_id: round(r.activation, 7) for r in active.collect()} == want
    assert [r.node_id for r in A.significant(active).orderBy("rn").collect()] == kept
    sums = A.normalised(g.edges).groupBy("src_id").agg(F.sum("weight").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-12 for r in sums)
    sub = [(r.from_id, r.to_id, r.dep_type) for r in A.subgraph(A.significant(active), g.edges).orderBy("rn", "first_seen").collect()]
    if given == [0, 4]:
        assert sub == [(3, 3, 27), (1, 3, 24), (0, 1, 2), (0, 1, 37)]
        padded = A.significant_padded(active)
        assert [r.node_id for r in padded.orderBy("rn").collect()] == [3, 1, 0, 0, 0]
        assert A.subgraph(padded, g.edges).count() == 8 and A.capped(A.subgraph(padded, g.edges), 7).count() == 7


def test_cut_edge_cases(spark):
    rows = [(1, 0, 1.0), (1, 1, 1.0), (1, 2, 1.0), (2, 5, 0.3), (3, 0, 3.0), (3, 1, 2.0), (3, 2, 1.0), (4, 0, 1e-7), (4, 1, -2.0)]
    active = spark.createDataFrame(rows, "query_id bigint, node_id bigint, activation double")
    got = {}
    for r in A.significant(active).orderBy("query_id", "rn").collect():
        got.setdefault(r.query_id, []).append(r.node_id)
    assert got == {1: [0], 2: [5], 3: [0]}  # all equal: one; a single one stays; the first of two equal gaps; none above the floor
    assert A.significant(active, min_gap=5.0).where("query_id = 3").count() == 3
    assert A.significant(active.limit(0)).count() == 0


def test_the_cut_does_not_depend_on_the_ranges(spark):
    import random

    rng = random.Random(5)
    rows = [(q, n, rng.choice([0.1, 0.2, 0.2, 0.5, rng.random()])) for q in range(3) for n in range(400 if q else 1500)]
    active = spark.createDataFrame(rows, "query_id bigint, node_id bigint, activation double").repartition(7)
    got = {}
    for r in A.significant(active).collect():
        got.setdefault(r.query_id, []).append((r.rn, r.node_id))
    for q in range(3):
        ranked = sorted((-round(a, 9), n) for k, n, a in rows if k == q)
        gaps = [round(ranked[i + 1][0] - ranked[i][0], 9) for i in range(len(ranked) - 1)]
        cut = gaps.index(max(gaps)) + 1
        assert sorted(got[q]) == [(i + 1, n) for i, (_, n) in enumerate(ranked[:cut])]


def test_the_plan_of_a_step_does_not_grow(spark):
    g = branching(spark)
    anchors = spark.createDataFrame([(7, 0)], "query_id bigint, node_id bigint")
    weights = A.normalised(g.edges)
    sizes = [A.spread(anchors, weights, k)._jdf.queryExecution().optimizedPlan().toString().count("\n") for k in (2, 3, 6)]
    assert len(set(sizes)) == 1


def test_prompts(spark):
    g = ConceptGraph(spark)
    g.ingest_sentences([[tok("мальчик", "nsubj", 1), tok("спать", "ROOT", 0)], [tok("уставший", "amod", 1), tok("мальчик", "ROOT", 0)]])
    asked = spark.createDataFrame([(1, "что мальчик"), (2, "nothing here"), (3, "какой мальчик"), (4, "")], "query_id bigint, query string")
    rows = {r.query_id: r for r in Q.run_queries(g.graph, asked).collect()}
    assert rows[1].intent == "factual" and "key concepts: спать\n" in rows[1].answer and rows[1].answer.endswith("answer:")
    assert rows[2].answer == rows[4].answer == Q.NOTHING_FOUND
    assert rows[3].intent == "procedural" and rows[2].intent == "definitional"
    compat = Q.run_queries(g.graph, asked.where("query_id = 1"), compat=True).first().answer
    assert "- 'мальчик' --(nsubj, strength:0.10)--> 'спать'\n" in compat
    both = A.spread(Q.question_anchors(asked.where("query_id = 1"), g.graph), A.normalised(g.graph.edges, "both"), 1)
    assert {r.node_id for r in both.collect()} == {0, 1, 2}


def test_functions(spark):
    rows = spark.createDataFrame([(" \t\n", "a/B.PDF", "nsubj", 2), (None, "a.d/x", None, None), (" x", "p.Html", "ROOT", 99)], "t string, p string, l string, c int")
    got = rows.select(not_blank(F.col("t")), suffix(F.col("p")), label_to_code(F.col("l")), code_to_label(F.col("c")), intent(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(False, ".pdf", 2, "nsubj", "definitional"), (False, "", 0, "UNKNOWN", "definitional"), (True, ".html", 1, "UNKNOWN", "definitional")]


def test_merge_is_independent_of_the_split(spark):
    rows = spark.createDataFrame([(i, [("a", "nsubj", 1), (f"v{i % 3}", "ROOT", 0)]) for i in range(1, 13)], SENTS)
    whole = {tuple(r) for r in G.lemma_edges(rows, G.clock(rows)).collect()}
    ticks = G.clock(rows)
    halves = [G.lemma_edges(rows.where(c), ticks) for c in ("sent_id <= 5", "sent_id > 5")]
    assert {tuple(r) for r in G.merge_edges(*halves).collect()} == whole
