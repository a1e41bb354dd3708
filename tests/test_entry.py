"""The driver's contract, and SQL parity of cheap queries."""

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
PARITY = ("dep_codes", "head_status", "edge_upsert", "graph_merge_incremental", "significant_nodes", "render_answer", "p3_found")


def test_every_query_has_a_callable_and_sql_names_exist():
    queries = entry.queries()
    assert all(callable(f) for f in queries.values()) and set(entry.oracle_sql()) <= set(queries)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", PARITY)
def test_parity(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    want = con.sql(entry.oracle_sql()[name])
    columns = sorted(want.columns)
    got = entry.queries()[name](spark, DATA).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.select(*[f'"{c}"' for c in columns]).fetchall()))
