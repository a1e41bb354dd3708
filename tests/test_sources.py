"""Folders, parsing, archive states, streaming and stored modules."""

import os

from pyspark.sql import functions as F

from mycelia.operators import extensions as X
from mycelia.operators.graph import build
from mycelia.operators.numbering import dense_number
from mycelia.plans import store
from mycelia.sources import files
from mycelia.streaming import ingest


def folder(tmp_path):
    d = tmp_path / "drop"
    (d / "below").mkdir(parents=True)
    (d / "a.txt").write_text("Entropy is disorder. Disorder is linked, entropy too!")
    (d / "b.HTML").write_text("<html><style>x{}</style><p>Heat &amp; light</p><script>no()</script></html>")
    (d / "c.pdf").write_bytes(b"%PDF")
    (d / "d.md").write_text(" \n\t")
    (d / "below" / "e.txt").write_text("not read")
    return str(d)


def test_parse_folder(spark, tmp_path):
    read = files.read_folder(spark, folder(tmp_path))
    elements = files.parse(read).persist()
    status = {os.path.basename(r.path): (r.status, r.n_sentences) for r in files.outcomes(read, elements).collect()}
    assert status == {"a.txt": ("success", 2), "b.HTML": ("success", 1), "c.pdf": ("failed", 0), "d.md": ("empty", 0)}
    lemmas = {t.lemma for r in elements.where("type = 'text'").collect() for t in r.content.tokens}
    assert {"entropy", "heat", "light"} <= lemmas and "no" not in lemmas
    own = files.parse(read, {"pdf": lambda b: "one two. three", "auto": lambda b: b.decode(), "html": lambda b: 1 / 0})
    assert {os.path.basename(r.path) for r in own.where("type = 'error'").collect()} == {"b.HTML"}
    assert own.where("path LIKE '%c.pdf' AND type = 'text'").count() == 2


def test_stream_counts_once(spark, tmp_path):
    drop, out = folder(tmp_path), str(tmp_path / "store")
    for _ in range(2):
        ingest.start(spark, drop, out, str(tmp_path / "ck"), once=True).awaitTermination()
    first = {(r.src, r.dst): r.repetitions for r in ingest.edges(spark, out).collect()}
    with open(os.path.join(drop, "f.txt"), "w") as f:
        f.write("Entropy is disorder.")
    ingest.start(spark, drop, out, str(tmp_path / "ck"), once=True).awaitTermination()
    second = {(r.src, r.dst): r.repetitions for r in ingest.edges(spark, out).collect()}
    assert second["entropy", "is"] == first["entropy", "is"] + 1
    read = files.read_folder(spark, os.path.join(drop, "f.txt"))
    ingest.merge_batch(read, 1, out)  # delivered again: its folder is written anew
    assert {(r.src, r.dst): r.repetitions for r in ingest.edges(spark, out).collect()} == second
    assert spark.read.parquet(f"{out}/dead_letters").select("path").distinct().count() == 1


def test_modules(spark, tmp_path):
    def graph(words):
        return build(spark.createDataFrame([(1, [(w, "nsubj", 1) for w in words[:-1]] + [(words[-1], "ROOT", 0)])], "sent_id bigint, tokens array<struct<lemma:string,dep:string,head_offset:int>>"))

    store.save(graph(["a", "b", "c"]), str(tmp_path), "one")
    store.save(graph(["a", "b"]), str(tmp_path), "two")
    both = store.mount(spark, str(tmp_path), ["one", "two"])
    assert both.nodes.count() == 3 and {r.repetitions for r in both.edges.collect()} == {1, 2}
    assert store.mount(spark, str(tmp_path), ["two"]).edges.count() == 1


def test_cli_counts_a_repeated_sentence_as_two(spark, tmp_path):
    from mycelia import cli

    for name in ("x", "y"):
        (tmp_path / name / "notes").mkdir(parents=True)
    (tmp_path / "x" / "notes" / "a.txt").write_text("boy sleeps. tired boy. boy sleeps.")
    (tmp_path / "y" / "notes" / "b.txt").write_text("old boy.")
    kept = str(tmp_path / "store")
    for path in ("x/notes", "y/notes"):
        assert cli.main(["--store", kept, "ingest", str(tmp_path / path)]) == 0
    names = [r.module for r in store.modules(spark, kept).collect()]
    assert len(names) == 2  # folders of one name do not replace each other
    one = store.mount(spark, kept, [n for n in names if store.new_module(spark, kept, str(tmp_path / "x" / "notes")).rpartition("-")[0] in n])
    lemma = {r.node_id: r.lemma for r in one.nodes.collect()}
    edges = {(lemma[r.src_id], lemma[r.dst_id]): (r.repetitions, round(r.conductance, 10), r.last_op) for r in one.edges.collect()}
    assert edges == {("boy", "sleeps"): (2, 0.1909090909, 3), ("tired", "boy"): (1, 0.1, 2)}
    assert cli.main(["--store", kept, "ingest", str(tmp_path / "x" / "notes")]) == 0  # again: the sightings add up
    again = store.mount(spark, kept, [r.module for r in store.modules(spark, kept).collect()])
    assert max(r.repetitions for r in again.edges.collect()) == 4
    assert cli.main(["--store", kept, "query", "boy"]) == 0 and cli.main(["--store", kept, "stats"]) == 0 and cli.main(["ingest", str(tmp_path / "none")]) == 1


def test_stream_clock_and_compaction(spark, tmp_path):
    drop, out = tmp_path / "drop", str(tmp_path / "store")
    drop.mkdir()
    for k, text in enumerate(("a b. a b. c d.", "a b.")):
        (drop / f"{k}.txt").write_text(text)
        ingest.start(spark, str(drop), out, str(tmp_path / "ck"), once=True).awaitTermination()
    want = {("a", "b", 3, 4), ("c", "d", 1, 3)}
    got = lambda folder: {(r.src, r.dst, r.repetitions, r.last_op) for r in ingest.edges(spark, folder).collect()}
    assert got(out) == want
    ingest.compact(spark, out, str(tmp_path / "one"))
    assert got(str(tmp_path / "one")) == want


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    import pytest

    from mycelia.session import ensure_checkpoint_dir

    unset = SimpleNamespace(isDefined=lambda: False)
    jsc = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset))
    given = []
    sc = SimpleNamespace(_jsc=jsc, master="spark://host:7077", getConf=lambda: {}, setCheckpointDir=given.append)
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc))
    sc.getConf = lambda: {"spark.checkpoint.dir": "/shared"}
    ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc))
    assert given == ["/shared"]


def test_archive_state(spark):
    rows = spark.createDataFrame(
        [(1, "a", "2024-01-01", None), (2, "a", "2024-01-02", "failed"), (2, "a", "2024-01-02", "failed"), (3, "b", "2024-01-01", "success"), (4, None, "2024-01-01", "success")],
        "event_id bigint, file_path string, seen_at string, archived string",
    )
    assert {tuple(r) for r in files.archive_state(rows).collect()} == {("a", "failed"), ("b", "success")}


def test_dense_number(spark):
    rows = spark.range(500).select((F.col("id") * 7 % 503).alias("k"))
    got = dense_number(rows, ["k"], "n", start=5).orderBy("k").collect()
    assert [r.n for r in got] == list(range(5, 505))
    assert dense_number(rows.limit(0), ["k"], "n").count() == 0


def test_extensions(spark):
    facts = spark.createDataFrame([("a", "is", "b"), ("b", "is", "c"), ("c", "is", "d"), ("d", "is", "a"), ("x", "like", "y"), (None, "is", "a")], "src string, relation string, dst string")
    got = {(r.src, r.dst): r.depth for r in X.closure(facts, ["is"], symmetric=["like"]).collect()}
    assert len(got) == 16 + 2 and got["y", "x"] == 0 and got["a", "c"] == 1 and got["a", "a"] == 2
    ring = spark.createDataFrame([("a", "is", "b"), ("b", "near", "c")], "src string, relation string, dst string")
    assert {(r.src, r.dst) for r in X.closure(ring, ["is"], inherited=[("is", "near")], symmetric=["near"]).collect()} == {("a", "b"), ("b", "c"), ("c", "b"), ("a", "c"), ("c", "a")}
    chain = spark.createDataFrame([(f"n{i:03}", "is", f"n{i + 1:03}", f"s{i % 3}") for i in range(12)], "src string, relation string, dst string, source string")
    assert X.emergence(chain, ["is"]).count() == 12 * 13 // 2 - 12
    line = spark.createDataFrame([("c", "b"), ("b", "a"), ("z", "z2"), ("z2", "z")], "src string, dst string")
    assert {r.node: r.level for r in X.levels(line).collect()} == {"a": 0, "b": 1, "c": 2}
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0])], "vec_id bigint, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in X.nearest(vectors, vectors.where("vec_id = 0"), 2).orderBy("rank").collect()] == [(0, 1), (0, 2)]
    assert X.nearest(vectors, vectors.limit(0)).count() == 0
