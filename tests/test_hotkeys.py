"""Hub report against brute force, with dirty rows and a hub that holds a third of all edges."""

import random

from mycelia.operators.hotkeys import hub_report

EDGE = "edge_id bigint, from_node_id bigint, to_node_id bigint, dep_type int, repetition_counter bigint, extra string"
NODE = "node_id bigint, edge_count bigint, kind string"


def brute(edges, nodes):
    rows = {e[0]: e for e in edges if e[0] is not None and e[1] is not None and e[2] is not None and e[2] >= 0}
    strength, outs = {}, {}
    for _, f, t, d, n, _x in rows.values():
        strength[f, t, d or 0] = strength.get((f, t, d or 0), 0) + (n or 0)
        outs.setdefault(f, set()).add((t, d or 0))
    best = {}
    for (f, t, d), s in strength.items():
        best[t] = min(best.get(t, (1, 0, 0)), (-s, f, d))
    out = {(t, "in", f, d) for t, (_, f, d) in best.items()}
    return out | {(n, "count", -1, -1) for n, c in {x[0]: x[1] for x in nodes if x[0] is not None}.items() if c is None or c != len(outs.get(n, ()))}


def test_hub_report(spark):
    rng = random.Random(3)
    edges = [(i, rng.randrange(40), 0 if rng.random() < 0.4 else rng.choice([None, -1, *range(30)]), rng.choice([None, 1, 2]), rng.choice([None, 1, 2, 3]), "x") for i in range(900)]
    edges += rng.sample(edges, 20) + [(None, 1, 1, 1, 1, "x"), (9999, None, 1, 1, 1, "x")]
    nodes = [(i, rng.choice([None, 3, 10, 20]), "n") for i in range(45)]
    nodes += nodes[:4] + [(None, 1, "n")]
    got = hub_report(spark.createDataFrame(edges, EDGE), spark.createDataFrame(nodes, NODE)).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == brute(edges, nodes)


def test_empty(spark):
    edges, nodes = spark.createDataFrame([], EDGE), spark.createDataFrame([(1, 0, "n"), (2, 5, "n")], NODE)
    assert {tuple(r) for r in hub_report(edges, nodes).collect()} == {(2, "count", -1, -1)}
    assert hub_report(edges, nodes.limit(0)).count() == 0
