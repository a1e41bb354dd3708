"""Activation of many questions leaves no rows of all active nodes on the disk."""

from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
from mycelia.operators import batches as B

NODES, ASKED = 800, 300
QUERIES = ("active_nodes", "induced_subgraph_compat", "significant_nodes", "spread_3", "capped_edges", "render_answer", "significant_nodes_compat", "top_k_activated", "induced_subgraph", "render_context", "spread_2_bidirectional")


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """A hub with an edge to every node, a ring, a node without edges, and many questions for few sets of anchors."""
    import duckdb

    d, con = str(tmp_path_factory.mktemp("hub")), duckdb.connect()
    for name, sql in {
        "graph_node": f"SELECT i AS node_id, 'word' || i AS lemma FROM range({NODES + 1}) t(i)",
        "graph_edge": f"""SELECT row_number() OVER () AS edge_id, * FROM (SELECT 0::BIGINT AS from_node_id, i AS to_node_id, 2 AS dep_type, 1 AS repetition_counter, i AS last_activated_op_count, 0.1::DOUBLE + i % 7 AS conductance
 FROM range(1, {NODES}) t(i) UNION ALL SELECT i, (i * 7 + 1) % {NODES}, 3, 2, i, 0.2::DOUBLE FROM range({NODES}) t(i))""",
        "user_question": f"SELECT i AS query_id, CASE i % 4 WHEN 0 THEN 'what is word0' WHEN 1 THEN 'word0 and word5' WHEN 2 THEN 'why word{NODES} or word3' ELSE 'nothing here' END AS query_text FROM range(1, {ASKED + 1}) t(i)",
        "dep_label": "SELECT 2 AS dep_code, 'nsubj' AS dep_name UNION ALL SELECT 3, 'dobj'",
    }.items():
        con.execute(f"COPY ({sql}) TO '{d}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    return d, con


def rows(found):
    return Counter(tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in found)


@pytest.mark.parametrize("name", QUERIES)
def test_equal_to_sql_with_little_shuffled(spark, tables, name):
    d, con = tables
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    got = entry.queries()[name](spark, d)
    columns = sorted(got.columns)
    got = got.select(*columns).collect()
    assert written() - before < 1 << 19
    want = con.sql(entry.oracle_sql()[name])
    assert rows(map(tuple, got)) == rows(want.select(*[f'"{c}"' for c in columns]).fetchall())


@pytest.mark.parametrize("steps", (0, 1, 2, 3))
def test_the_most_active_nodes_are_those_of_all_nodes(steps, monkeypatch):
    rng = np.random.default_rng(3)
    src, dst = rng.integers(0, 400, 5000), (400 * rng.random(5000) ** 4).astype(np.int64)
    moves = B.Moves(src, dst, rng.random(5000))
    for light in (1e-4, 0.05, 10.0):
        monkeypatch.setattr(B, "LIGHT", light)
        for given in ([3], [0, 7, 999], [998, 999]):
            at, alone = moves.places(np.array(given))
            x = moves.spread([at], steps)[:, 0]
            above = x > B.FLOOR
            for k in (None, 1, 5):
                want = B._head(moves.ids[above], x[above], alone, B.FLOOR, steps, k)
                assert [list(c) for c in moves.head(at, alone, steps, k)] == [list(c) for c in want]


def test_pushing_and_pulling_are_the_same_step(monkeypatch):
    rng = np.random.default_rng(4)
    moves = B.Moves(rng.integers(0, 3000, 9000), (3000 * rng.random(9000) ** 3).astype(np.int64), rng.random(9000))
    at = [np.array([0, 5]), np.array([7])]
    monkeypatch.setattr(B, "PULLED", 0.0)
    pulled = moves.spread(at, 3).copy()
    monkeypatch.setattr(B, "PULLED", 9.0)
    assert moves.hubs and np.allclose(pulled, moves.spread(at, 3), rtol=1e-12, atol=0)
