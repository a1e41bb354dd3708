"""Fixed-capacity windows filled by lexical retrieval.

Documents are dealt to shards by what they say: every text has a profile (hashed byte trigrams, projected to ``DIMENSIONS``
numbers), centres are fitted to the profiles of a bounded sample, and every document goes to the shard of its nearest centre, so that its
neighbours are where it is. There are as many centres as make shards of about ``SHARD_BYTES``; one that would hold more than ``MOST_BYTES``
(or, beyond ``CENTRES``, any) is dealt on by the hash of the unique id. Each shard encodes its texts once, builds a BM25 inverted index over the
token ids and packs every window kind: the longest unused document is the seed, its unused neighbours follow by
falling score as long as they fit, and the space left takes the largest unused documents that fit. A
document longer than the capacity, and no other, is split: full windows first, its rest is an item.

Windows of a shard that stay under ``WELL_FILLED`` are opened again: the items of up to ``MERGED_SHARDS``
shards are packed together by best fit on their sizes alone.

Defined results: null, empty and tokenless texts take no space and are left out; repeated documents are items
of their own (ids are unique; a repeated id counts once); window kinds with a null or non-positive capacity
or a null tokenizer have no row; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mycelia.llm.tokenizer import VOCABULARIES, Encoder
from mycelia.session import cut_lineage

#: Bytes of text in a shard: those aimed at, and those beyond which it is divided.
SHARD_BYTES, MOST_BYTES = 2_800_000, 9_000_000
#: Documents (about so many, by the hash of their id) whose profiles the centres are fitted to, and most centres; both bound what the driver and the tasks hold.
SAMPLE_DOCUMENTS, CENTRES = 20_000, 256
DIMENSIONS, BUCKETS = 32, 1 << 13
MERGED_SHARDS = 64
WELL_FILLED = 0.97
K1, B = 1.2, 0.75
#: Terms of a query document by falling idf; the recall of the README is measured with it against queries of all terms.
QUERY_TERMS = 160

PLACEMENTS = "window_id int, shard bigint, container bigint, position int, doc_id bigint, part int, start_token bigint, n_tokens bigint, capacity bigint"
_COLUMNS = [c.split()[0] for c in PLACEMENTS.split(", ")]


def profiles_of(texts: pa.Array) -> np.ndarray:
    """The :func:`profile` of every text, read from the array's bytes."""
    texts = texts.cast(pa.large_string())
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return np.array([profile(raw[a:b]) for a, b in zip(offs[:-1], offs[1:], strict=True)], np.float32).reshape(-1, DIMENSIONS)


def profile(text: np.ndarray) -> np.ndarray:
    """The direction of the hashed trigrams of a text's bytes; documents of one language and kind point alike."""
    raw = text.astype(np.int32)
    grams = (raw[:-2] * 7919 + raw[1:-1] * 131 + raw[2:]) & (BUCKETS - 1) if len(raw) > 2 else raw
    counts = np.bincount(grams, minlength=BUCKETS)
    some = np.flatnonzero(counts)
    out = np.log1p(counts[some]).astype(np.float32) @ _projection()[some]
    return out / max(float(np.linalg.norm(out)), 1e-9)


@lru_cache(maxsize=1)
def _projection() -> np.ndarray:
    return np.random.default_rng(0).standard_normal((BUCKETS, DIMENSIONS)).astype(np.float32)


def fitted(profiles: np.ndarray, centres: int, starts: int = 4) -> np.ndarray:
    """Centres of the profiles, the best of several starts: far-apart ones to begin with, then ten rounds of means. The same for the same profiles."""
    best, most = profiles[:1], -1.0
    for start in range(starts):
        rng = np.random.default_rng(start)
        chosen = profiles[rng.integers(len(profiles), size=1)]
        near = profiles @ chosen[0]
        while len(chosen) < min(centres, len(profiles)):
            far = np.maximum(1 - near, 0) ** 2
            if not far.sum() > 1e-9:
                break
            chosen = np.vstack([chosen, profiles[rng.choice(len(profiles), p=far / far.sum())]])
            near = np.maximum(near, profiles @ chosen[-1])
        for _ in range(10):
            own = np.argmax(profiles @ chosen.T, axis=1)
            for k in range(len(chosen)):
                if (own == k).any():
                    mean = profiles[own == k].mean(axis=0)
                    chosen[k] = mean / max(float(np.linalg.norm(mean)), 1e-9)
        fit = float((profiles @ chosen.T).max(axis=1).sum())
        if fit > most:
            best, most = chosen, fit
    return best


def shards_of(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """``(centres, parts)``: the centres of the shards and into how many parts each is divided. ``rows`` has ``doc_id, text``."""
    count, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    share = SAMPLE_DOCUMENTS / max(count, 1)
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) <= int(min(share, 1.0) * (1 << 40)))

    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(profiles_of(texts).tolist(), pa.list_(pa.float32())), pc.binary_length(texts).cast(pa.int64())], names=["doc_id", "profile", "bytes"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = sorted(sample.mapInArrow(profiles, f"doc_id {kind}, profile array<float>, bytes bigint").collect())
    if not found:
        return np.zeros((1, DIMENSIONS), np.float32), np.ones(1, np.int64)
    points, size = np.array([r.profile for r in found], np.float32), np.array([r.bytes for r in found], np.int64)
    centres = fitted(points, int(min(CENTRES, max(1, -(-total // SHARD_BYTES)))))
    held = np.bincount(np.argmax(points @ centres.T, axis=1), weights=size, minlength=len(centres)) / size.sum() * total
    return centres, np.maximum(1, np.ceil(held / MOST_BYTES)).astype(np.int64)


def dealt(rows: DataFrame, centres: np.ndarray, parts: np.ndarray) -> DataFrame:
    """``rows`` (``doc_id, text``) with their ``shard``."""
    first = np.cumsum(parts) - parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.argmax(profiles_of(batch.column("text")) @ centres.T, axis=1)
            spread = np.asarray(batch.column("hash")) % parts[own]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(first[own] + spread, pa.int64())], names=["doc_id", "text", "shard"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("hash")).mapInArrow(run, f"doc_id {kind}, text string, shard bigint")


class Statistics(NamedTuple):
    """Of all documents: in how many each term occurs, their number, and that of their tokens."""

    df: np.ndarray
    documents: int
    tokens: int


def statistics(rows: DataFrame, tokenizer: str, folder: str) -> Statistics:
    """Counted in one array a task and summed per term, as many rows as the tokenizer has ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, folder)
        df = np.zeros(0, np.int64)
        documents = tokens = 0
        for batch in batches:
            offsets, ids = encoder.encode(batch.column(0))
            if len(ids):
                df = np.pad(df, (0, max(0, int(ids.max()) + 1 - len(df))))
            for i in range(0, len(offsets) - 1, 64):  # a table of 64 documents by all terms: no sorting
                ends = offsets[i : i + 65]
                held = np.zeros((len(ends) - 1, len(df)), bool)
                held[np.repeat(np.arange(len(ends) - 1), np.diff(ends)), ids[ends[0] : ends[-1]]] = True
                df += np.count_nonzero(held, axis=0)
            documents, tokens = documents + len(offsets) - 1, tokens + len(ids)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *some.tolist()], pa.int32()), pa.array([documents, tokens, *df[some].tolist()], pa.int64())], names=["term", "n"])

    counted = rows.select("text").mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r.term: r.n for r in counted}
    df = np.zeros(max(found, default=0) + 1, np.int64)
    for term, n in found.items():
        if term >= 0:
            df[term] = n
    return Statistics(df, found.get(-2, 0), found.get(-1, 0))


class Neighbours:
    """``self[q]``: the BM25 score of every document of a shard with document ``q`` as the query, nought for itself and those without a shared term.

    A query is the ``QUERY_TERMS`` heaviest terms of its document. Terms in more than half of all documents have no weight, as in the formula with the idf
    floored at nought. Scores are made when they are asked for.
    """

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, statistics: Statistics | None = None, query_terms: int | None = None):
        self.n = n = len(offsets) - 1
        self.query_terms = query_terms or QUERY_TERMS
        size = np.diff(offsets)
        vocabulary = int(ids.max()) + 1 if len(ids) else 1
        kind = np.int32 if n * vocabulary < 1 << 31 else np.int64
        pair, tf = np.unique(np.repeat(np.arange(n, dtype=kind), size) * kind(vocabulary) + ids.astype(kind), return_counts=True)
        doc, term = pair // vocabulary, pair % vocabulary
        df = np.bincount(term, minlength=vocabulary)
        known = statistics or Statistics(df, n, int(size.sum()))
        all_df = known.df[:vocabulary]
        idf = np.maximum(np.log((known.documents - all_df + 0.5) / (all_df + 0.5)), 0.0)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / max(known.tokens / max(known.documents, 1), 1.0)))
        keep = (df[term] > 1) & (weight > 0)
        doc, term, weight = doc[keep], term[keep], weight[keep].astype(np.float32)
        self.terms, self.weight, self.first = term, idf[term], np.searchsorted(doc, np.arange(n + 1))
        by_term = np.argsort(term, kind="stable")
        self.posting_doc, self.posting_weight = doc[by_term].astype(np.intp), weight[by_term].astype(np.float64)
        self.start = np.searchsorted(term[by_term], np.arange(vocabulary + 1))
        self._made: dict[int, np.ndarray] = {}

    def __getitem__(self, q: int) -> np.ndarray:
        found = self._made.get(q)
        if found is None:
            found = self._made[q] = self._scored(q)
        return found

    def _scored(self, q: int) -> np.ndarray:
        own = slice(self.first[q], self.first[q + 1])
        terms = self.terms[own]
        if len(terms) > self.query_terms:
            terms = terms[np.argpartition(-self.weight[own], self.query_terms)[: self.query_terms]]
        spans = [slice(a, b) for a, b in zip(self.start[terms].tolist(), self.start[terms + 1].tolist(), strict=True)]
        if not spans:
            return np.zeros(self.n, np.float32)
        docs, weights = (np.concatenate([column[x] for x in spans]) for column in (self.posting_doc, self.posting_weight))
        score = np.bincount(docs, weights=weights, minlength=self.n).astype(np.float32)
        score[q] = 0
        return score


def head_of(score: np.ndarray, items: np.ndarray, step: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """The first ``items`` by falling score, ties by place, and the others; ties at the border are all among the first."""
    if len(items) <= 2 * step:
        head, rest = items, items[:0]
    else:
        own = score[items]
        first = own >= np.partition(own, len(items) - step)[len(items) - step]
        head, rest = items[first], items[~first]
    return head[np.argsort(-score[head], kind="stable")], rest


class Placed:
    """The scores of items: item ``i`` is document ``item[i]``."""

    def __init__(self, near: Neighbours, item: np.ndarray):
        self.near, self.item = near, item

    def __getitem__(self, i: int) -> np.ndarray:
        return self.near[int(self.item[i])][self.item]


def pack(sizes: np.ndarray, capacity: int, neighbours: Placed | None) -> list[list[int]]:
    """Items (all within the capacity) put into windows: seeds by falling size, then neighbours, then the largest that fit."""
    order = np.lexsort((np.arange(len(sizes)), -sizes))  # falling sizes, ties by position
    by_size = -sizes[order]
    unused = np.ones(len(sizes), bool)
    size_of = sizes.tolist()
    smallest = min(size_of, default=0)
    free = list(range(len(order)))  # next unused rank at or after each rank, path-compressed
    free.append(len(order))

    def next_free(r: int) -> int:
        root = r
        while free[root] != root:
            root = free[root]
        while free[r] != root:
            free[r], r = root, free[r]
        return root

    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))

    def take(i: int) -> None:
        unused[i] = False
        free[rank[i]] = rank[i] + 1

    windows = []
    while (r := next_free(0)) < len(order):
        seed = int(order[r])
        take(seed)
        window, room = [seed], capacity - int(sizes[seed])
        if neighbours is not None and room > 0:
            left = np.flatnonzero(unused & (sizes <= room))
            if len(left):
                score = neighbours[seed]
                left = left[score[left] > 0]
            while len(left) and room >= smallest:
                head, left = head_of(score, left)
                for i in head.tolist():
                    if size_of[i] <= room:
                        take(i)
                        window.append(i)
                        room -= size_of[i]
                left = left[sizes[left] <= room]
        while room > 0:
            r = next_free(int(np.searchsorted(by_size, -room, "left")))
            if r >= len(order):
                break
            i = int(order[r])
            take(i)
            window.append(i)
            room -= int(sizes[i])
        windows.append(window)
    return windows


def _rows(kind: tuple, shard: int, base: int, doc: np.ndarray, part: np.ndarray, start: np.ndarray, size: np.ndarray, windows: list[list[int]]) -> list[tuple]:
    window_id, capacity, _ = kind
    return [(window_id, shard, base + c, p, int(doc[i]), int(part[i]), int(start[i]), int(size[i]), capacity) for c, w in enumerate(windows) for p, i in enumerate(w)]


def pack_shard(shard: int, doc_ids: np.ndarray, texts: pa.Array, kinds: list[tuple], folder: str, known: dict[str, Statistics]) -> list[tuple]:
    """The placements of one shard for every window kind ``(window_id, capacity, tokenizer)``; ``known`` are the statistics of every tokenizer."""
    out: list[tuple] = []
    for tokenizer in sorted({k[2] for k in kinds}):
        offsets, ids = _encoder(tokenizer, folder).encode(texts)
        near = Neighbours(ids.astype(np.int64), offsets, known[tokenizer])
        size = np.diff(offsets)
        for kind in (k for k in kinds if k[2] == tokenizer):
            capacity = kind[1]
            whole = size // capacity
            rest = size - whole * capacity
            long_doc = np.repeat(np.arange(len(size)), whole)
            part = np.arange(len(long_doc)) - np.repeat(np.cumsum(whole) - whole, whole)
            out += _rows(kind, shard, 0, doc_ids[long_doc], part, part * capacity, np.full(len(long_doc), capacity), [[i] for i in range(len(long_doc))])
            item = np.flatnonzero(rest)
            windows = pack(rest[item], capacity, Placed(near, item))
            out += _rows(kind, shard, len(long_doc), doc_ids[item], whole[item], whole[item] * capacity, rest[item], windows)
    return out


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _encoder(tokenizer: str, folder: str) -> Encoder:
    if (tokenizer, folder) not in _ENCODERS:
        _ENCODERS[tokenizer, folder] = Encoder(tokenizer, folder)
    return _ENCODERS[tokenizer, folder]


def packed_windows(documents: DataFrame, prompt_window: DataFrame, folder: str = VOCABULARIES) -> DataFrame:
    """``window_id, container, position, doc_id, part, start_token, n_tokens, capacity``: every piece of text in its place.

    ``prompt_window`` is a table of settings, one row a kind of window, and is read by the driver.
    """
    usable = prompt_window.where("window_id IS NOT NULL AND capacity > 0 AND tokenizer IS NOT NULL").dropDuplicates(["window_id"])
    kinds = [(r.window_id, int(r.capacity), r.tokenizer) for r in usable.orderBy("window_id").collect()]
    rows = documents.where("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''").select("doc_id", "text")
    centres, parts = shards_of(rows)
    shards = int(parts.sum())
    known = {tokenizer: statistics(rows, tokenizer, folder) for tokenizer in sorted({k[2] for k in kinds})}

    types = [pa.int64() if c.endswith("bigint") else pa.int32() for c in PLACEMENTS.split(", ")]

    def shard_of(rows: pa.Table) -> pa.Table:
        ids, first = np.unique(rows.column("doc_id").to_numpy(), return_index=True)  # a repeated id counts once
        texts = rows.column("text").take(pa.array(first)).cast(pa.large_string()).combine_chunks()
        placed = pack_shard(rows.column("shard")[0].as_py(), ids, texts, kinds, folder, known)
        columns = zip(*placed) if placed else [()] * len(types)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=_COLUMNS)

    first = cut_lineage(dealt(rows, centres, parts).groupBy("shard").applyInArrow(shard_of, PLACEMENTS))

    def reopened(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "part"])
        kind = (int(pdf["window_id"].iloc[0]), int(pdf["capacity"].iloc[0]), None)
        size = pdf["n_tokens"].to_numpy()
        windows = pack(size, kind[1], None)
        rows_ = _rows(kind, shards + int(pdf["shard"].min()) // MERGED_SHARDS, 0, pdf["doc_id"].to_numpy(), pdf["part"].to_numpy(), pdf["start_token"].to_numpy(), size, windows)
        return pd.DataFrame(rows_, columns=_COLUMNS)

    fill = first.groupBy("window_id", "shard", "container").agg(F.sum("n_tokens").alias("filled"))
    both = first.join(fill, ["window_id", "shard", "container"]).withColumn("well", F.col("filled") >= WELL_FILLED * F.col("capacity"))
    again = both.where("NOT well").withColumn("coarse", F.floor(F.col("shard") / MERGED_SHARDS)).groupBy("window_id", "coarse")
    second = again.applyInPandas(lambda pdf: reopened(pdf), PLACEMENTS)
    done = both.where("well").select(*_COLUMNS).unionByName(second)
    number = (F.col("shard") * F.lit(10**9) + F.col("container")).alias("container")
    return done.select("window_id", number, "position", "doc_id", "part", "start_token", "n_tokens", "capacity")


def window_fill(placements: DataFrame) -> DataFrame:
    """``window_id, containers, tokens, unused_share`` of each window kind."""
    per = placements.groupBy("window_id", "container").agg(F.sum("n_tokens").alias("filled"), F.max("capacity").alias("capacity"))
    return per.groupBy("window_id").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("filled").alias("tokens"), F.round(1 - F.sum("filled") / F.sum("capacity"), 6).alias("unused_share")
    )
