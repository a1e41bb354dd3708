"""Corpus encoding against the reference tokenizer, term counts against brute force."""

import os
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mycelia.llm import frequency, packing, tokenizer

pytestmark = pytest.mark.skipif(not os.path.isdir(tokenizer.VOCABULARIES), reason="no vocabulary files")
PIECES = ["a", "Bc", "é", "'", "s", "ll", "'re", "'ve", " ", "  ", "\n", "\t", "\xa0", "　", "1", "²", "٣", "!", "?", "漢字", "ก", "्", "​", "\x85", "😀", "'d", "\x1c", "<|endoftext|>"]


def test_ids_equal_the_tokenizer_and_decode():
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(os.path.join(tokenizer.VOCABULARIES, "byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    rng = random.Random(5)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(14))) for _ in range(4000)] + ["", None, "x" * 50_000, " " * 3000, "'s'll'tis"]
    encoder = tokenizer.Encoder("byte_bpe_50k")
    for array in (pa.array(texts), pa.array(["skip", *texts]).slice(1)):
        offsets, ids = encoder.encode(array)
        for i, t in enumerate(texts):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == (reference.encode(t, add_special_tokens=False).ids if t else [])
    for t in texts[:300]:
        assert "".join(t[a:b] for a, b, _ in encoder.pieces(t)) == t


def test_small_blocks_change_nothing(monkeypatch):
    texts = pa.array(["one two", "", "three's", None, "четыре 五", "x" * 100] * 20)
    encoder = tokenizer.Encoder("byte_bpe_50k")
    whole = encoder.encode(texts)
    monkeypatch.setattr(tokenizer, "SLICE_CHARS", 16)
    parts = encoder.encode(texts)
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()


def test_columns(spark):
    rows = spark.createDataFrame([(1, "a b", 0), (2, None, 0), (3, "", 0), (None, "c", 0)], "doc_id bigint, text string, ids int")
    got = {r.doc_id: r.ids for r in tokenizer.encode_column(rows).collect()}
    assert got[2] == got[3] == [] and len(got[1]) == 2 and None in got
    assert tokenizer.encode_column(rows.limit(0)).count() == 0
    assert {r.doc_id: r.n_tokens for r in tokenizer.count_column(rows, "doc_id", "text", "byte_bpe_50k").collect()}[1] == 2


def lists(spark, rows):
    data = [(i, [(x, "d", 0) for x in items] if items is not None else None) for i, items in rows]
    return spark.createDataFrame(data, "rec_id bigint, tokens array<struct<lemma:string,dep:string,head_offset:int>>")


def test_frequencies(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, [rng.choice(["the", "the", "", None, f"w{rng.randrange(60)}", f"u{i}"]) for _ in range(rng.randrange(9))]) for i in range(400)]
    rows += rows[:7] + [(900, None), (901, [])]
    distinct = {i: items for i, items in rows if items}
    occurrences = Counter(x for items in distinct.values() for x in items if x is not None)
    records = Counter(x for items in distinct.values() for x in {*items} if x is not None)
    for heavy in (1024, 3, 1):
        monkeypatch.setattr(frequency, "HEAVY", heavy)
        got = {r["item"]: (r.occurrences, r.records, r["mark"]) for r in frequency.lemma_frequencies(lists(spark, rows)).collect()}
        n = len(distinct)
        assert got == {k: (occurrences[k], c, "rare" if c < 3 else "common" if c > 0.05 * n else None) for k, c in records.items()}
    assert frequency.lemma_frequencies(lists(spark, [(1, None)])).count() == 0


def test_packing(spark):
    rng = random.Random(4)
    words = ["wave", "node", "волна", "charge", "link", "graph", "heat"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 90))), "e") for i in range(200)]
    docs += [(500, "node " * 400, "e"), (501, None, "e"), (502, "", "e"), (None, "x", "e"), (500, "node " * 400, "e")]
    kinds = spark.createDataFrame([(1, "s", 64, "byte_bpe_50k"), (2, "m", 128, "byte_bpe_50k"), (3, "bad", None, "byte_bpe_50k")], "window_id int, window_name string, capacity int, tokenizer string")
    rows = spark.createDataFrame(docs, "doc_id bigint, text string, extra string")
    got = packing.packed_windows(rows, kinds).toPandas()
    sizes = tokenizer.count_column(rows.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), "doc_id", "text", "byte_bpe_50k").toPandas().set_index("doc_id")["n_tokens"]
    sizes = sizes[sizes > 0]
    for window, capacity in ((1, 64), (2, 128)):
        own = got[got.window_id == window]
        assert own.groupby("doc_id").n_tokens.sum().to_dict() == sizes.to_dict()
        assert (own.groupby("container").n_tokens.sum() <= capacity).all()
        split = own.groupby("doc_id").size()
        assert set(split[split > 1].index) == set(sizes[sizes > capacity].index)
        assert own.container.nunique() <= -(-int(sizes.sum()) // capacity) * 1.05 + 1
    assert packing.packed_windows(rows.limit(0), kinds).count() == 0


def test_neighbours_by_brute_force():
    import math

    import numpy as np

    docs = [[1, 1, 2], [1, 3], [2, 2, 2, 4], [5], [1, 2, 4], [6, 7], [], [8, 9]]
    ids, offsets = np.array([x for d in docs for x in d]), np.cumsum([0, *map(len, docs)])
    mean, n = np.mean([len(d) for d in docs]), len(docs)
    df = Counter(t for d in docs for t in set(d))

    def score(q, d):
        out = 0.0
        for t in set(docs[q]) & set(docs[d]):
            idf = max(math.log((n - df[t] + 0.5) / (df[t] + 0.5)), 0)
            weight = lambda x: idf * docs[x].count(t) * 2.2 / (docs[x].count(t) + 1.2 * (0.25 + 0.75 * len(docs[x]) / mean))
            out += weight(d) if df[t] > 1 else 0
        return out

    near = packing.Neighbours(ids, offsets)
    for q in range(n):
        assert np.allclose(near[q], [score(q, d) if d != q else 0 for d in range(n)], atol=1e-6)
    # the statistics of all documents, not of the shard, weigh the terms
    wide = packing.Neighbours(ids, offsets, packing.Statistics(np.array([0, 400, 30, 2, 2, 1, 1, 1, 1, 1]), 1000, 9000))
    assert wide[0][1] > 0 == near[0][1] or near[0][1] > 0
    few = packing.Neighbours(ids, offsets, query_terms=1)
    assert (few[0] <= near[0] + 1e-6).all()
    scores = np.array([3, 1, 2, 2, 0.5] * 60)
    head, rest = packing.head_of(scores, np.arange(300), 48)
    assert head.tolist() == sorted(range(300), key=lambda i: (-scores[i], i))[: len(head)] and len(head) + len(rest) == 300 and len(head) >= 48


def test_shards_follow_what_is_said(spark):
    import numpy as np

    words = {"a": "wave node charge graph heat", "b": "волна узел заряд граф тепло", "c": "波动 节点 电荷 图 热量"}
    rows = [(i, " ".join(words["abc"[i % 3]].split()[(i + j) % 5] for j in range(12))) for i in range(240)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    centres = packing.fitted(packing.profiles_of(pa.array([t for _, t in rows])), 3)
    shard = {r.doc_id: r.shard for r in packing.dealt(table, centres, np.ones(3, np.int64)).collect()}
    assert len({shard[i] for i in range(3)}) == 3 and all(shard[i] == shard[i % 3] for i in shard)
    assert packing.profiles_of(pa.array(["", None, "x" * 100_000])).shape == (3, packing.DIMENSIONS)
    found = packing.statistics(table.unionByName(table), "byte_bpe_50k", tokenizer.VOCABULARIES)
    ids = [tokenizer.Encoder("byte_bpe_50k").encode(pa.array([t]))[1] for _, t in rows]
    assert found.documents == 480 and found.tokens == 2 * sum(map(len, ids))
    want = np.bincount(np.concatenate([np.unique(x) for x in ids]))
    assert (found.df == 2 * want).all()


def test_ids_decode_and_scans_compose(spark):
    import numpy as np

    texts = ["Été: it's 5.9 °C,  we'll see\n\n'tis 我们 🙂", "", None, " ", "x" * 5000]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    back = {r.doc_id: r.text for r in tokenizer.decode_column(tokenizer.encode_column(rows)).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert {r.doc_id: r.intact for r in tokenizer.round_trip(rows).collect()} == dict.fromkeys(range(5), True)
    encoder = tokenizer.Encoder("byte_bpe_50k")
    pieces = encoder.pieces(texts[0])
    assert "".join(texts[0][a:b] for a, b, _ in pieces) == texts[0] and all(encoder.decode(ids) == texts[0][a:b] for a, b, ids in pieces)
    # a scan of a whole equals the scans of its parts put together: the last reset of the left part carries over
    reset = np.array([1, 0, 0, 1, 0, 0, 0, 1, 0], bool)
    whole = tokenizer.scan(reset)
    for cut in range(1, 9):
        left, right = tokenizer.scan(reset[:cut]), np.where(reset[cut:], np.arange(cut, 9), -1)
        assert (np.concatenate([left, np.maximum(np.maximum.accumulate(right), left[-1])]) == whole).all()
