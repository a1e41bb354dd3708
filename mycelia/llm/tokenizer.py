"""Corpus encoding with a public byte-level BPE, pre-tokenised without a regular expression.

A whole Arrow batch is one array of code points. Each code point has a class (letter, number, white
space, other) and, from its class and its neighbours', a transition function of the splitter: "reset" (a piece starts here) or
"hold" (stay in the piece at hand). Such functions compose associatively, so the piece every code point is in comes from a prefix scan
(:func:`scan`) over the batch instead of a loop over text; a first scan finds the runs of one class, a second one the pieces. The
slices are dictionary-encoded once per batch and only unseen ones are merged; a per-worker cache keeps their ids. The offsets of
the pieces are retained (:meth:`Encoder.pieces`), and ids decode to the exact text (:func:`decode_column`).

Defined results: a null or empty text has the empty list of ids. Special-token strings inside a text are
ordinary text. Texts that are not valid Unicode cannot reach the operator (Spark strings are UTF-8).
"""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; a parameter of every function below.
VOCABULARIES = "/opt/tokenizers"

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: Code points of white space (Unicode White_Space). Fixed values.
WHITE = (
    list(range(0x09, 0x0E)) + [0x20, 0x85, 0xA0, 0x1680] + list(range(0x2000, 0x200B)) + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
#: Above this many code points a batch of slices is scanned by itself; bounds memory, not results.
SLICE_CHARS = 1 << 22
CACHE_PIECES = 1 << 19


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """The class of every code point, from the general categories of Unicode."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    points = np.r_[0:0xD800, 0xE000:0x110000].astype(np.uint32)
    everything = points.astype("<u4").tobytes().decode("utf-32-le")
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(pattern, everything):
            table[points[m.start() : m.end()]] = kind
    table[WHITE] = SPACE
    return table


def scan(reset: np.ndarray) -> np.ndarray:
    """The prefix scan of reset/hold functions: for every place the last place at or before it that resets. ``reset[0]`` must be true."""
    at = np.arange(len(reset), dtype=np.int32)  # a block is far shorter than 2^31
    return np.maximum.accumulate(np.multiply(at, reset, out=at), out=at)


def piece_starts(cp: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Indices in ``cp`` (the code points of all texts, one after another) at which pieces begin.

    ``text_starts``: the index of the first code point of each non-empty text.
    """
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = class_table()[cp]
    first = np.zeros(n + 1, bool)
    first[text_starts] = True
    first[n] = True
    change = first[:n].copy()
    change[1:] |= kind[1:] != kind[:-1]
    run = scan(change)  # where the run of one class begins that a code point is in
    start = change.copy()
    # the last white space before a non-space of the same text leaves its run; a plain blank joins what follows
    followed = np.zeros(n, bool)
    followed[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:n]
    start |= followed
    joined = np.zeros(n, bool)
    joined[1:] = followed[:-1] & (cp[:-1] == 0x20)
    start &= ~joined
    # contractions: an apostrophe that begins its run, then s d m t or ll ve re; what follows begins anew
    quote = np.flatnonzero((cp == 0x27) & start)
    quote = quote[run[quote] == quote]
    quote = quote[quote + 1 < n]
    quote = quote[~first[quote + 1]]
    if len(quote):
        a = cp[quote + 1]
        b = np.where((quote + 2 < n) & ~first[np.minimum(quote + 2, n)], cp[np.minimum(quote + 2, n - 1)], 0)
        one = np.isin(a, [ord(x) for x in "sdmt"])
        two = ((a == ord("l")) & (b == ord("l"))) | (((a == ord("v")) | (a == ord("r"))) & (b == ord("e")))
        start[quote[one | two] + 1] = False
        after = np.concatenate([quote[one] + 2, quote[two & ~one] + 3])
        start[after[after < n]] = True
    piece = scan(start)
    return np.flatnonzero(np.diff(piece, prepend=np.int32(-1)))


@lru_cache(maxsize=4)
def _encoder(name: str, folder: str):
    import tiktoken

    spec = importlib.util.spec_from_file_location("vocabularies", os.path.join(folder, "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Encodes Arrow string arrays; one per worker process and vocabulary."""

    def __init__(self, name: str, folder: str = VOCABULARIES):
        self._encoding = _encoder(name, folder)
        self._cache: dict[bytes, np.ndarray] = {}

    def _ids(self, piece: bytes) -> np.ndarray:
        ids = self._cache.get(piece)
        if ids is None:
            ids = np.array(self._encoding.encode_ordinary(piece.decode("utf-8")), np.int32)
            if len(piece) <= 64 and len(self._cache) < CACHE_PIECES:
                self._cache[piece] = ids
        return ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(offsets, ids)``: text ``i`` has ``ids[offsets[i]:offsets[i + 1]]``."""
        texts = texts.cast(pa.large_string())
        texts = texts.fill_null("")
        total = np.zeros(len(texts) + 1, np.int64)
        parts: list[np.ndarray] = []
        offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + SLICE_CHARS, "right")) - 1)
            bounds = offs[i : j + 1]
            counts, ids = self._encode_block(raw[bounds[0] : bounds[-1]], bounds - bounds[0])
            total[i + 1 : j + 1] = counts
            parts.append(ids)
            i = j
        return np.cumsum(total), np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def _encode_block(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(raw):
            return np.zeros(len(bounds) - 1, np.int64), np.zeros(0, np.int32)
        cp = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
        byte_of = np.flatnonzero((raw & 0xC0) != 0x80)  # first byte of each code point
        text_starts = np.searchsorted(byte_of, np.unique(bounds[:-1][bounds[:-1] < bounds[-1]]))
        starts = byte_of[piece_starts(cp, text_starts)]
        offsets = np.append(starts, len(raw)).astype(np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw.tobytes())])
        coded = pieces.dictionary_encode()
        unique = [self._ids(p) for p in coded.dictionary.to_pylist()]
        code = coded.indices.to_numpy()
        sizes = np.fromiter(map(len, unique), np.int64, len(unique))
        flat = np.concatenate(unique)
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        each = sizes[code]
        ends = np.cumsum(each)
        ids = flat[np.repeat(begin[code] - (ends - each), each) + np.arange(ends[-1])]
        piece_text = np.searchsorted(bounds, starts, "right") - 1
        # empty texts share their start with the next one: the last of equal bounds owns the bytes
        counts = np.bincount(piece_text, weights=each, minlength=len(bounds) - 1).astype(np.int64)
        return counts, ids

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids; bytes that are no UTF-8 by themselves (a list cut within a character) become replacement characters."""
        return self._encoding.decode_bytes(list(ids)).decode("utf-8", "replace")

    def pieces(self, text: str) -> list[tuple[int, int, list[int]]]:
        """``(start, end, ids)`` of each piece of one text, in code points."""
        cp = np.frombuffer(text.encode("utf-32-le"), "<u4")
        at = np.append(piece_starts(cp, np.zeros(min(1, len(cp)), np.int64)), len(cp))
        return [(int(a), int(b), self._ids(text[a:b].encode()).tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]


def encode_column(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """``key, ids``: the token ids of every row, in one narrow pass without a shuffle.

    Other columns of ``df`` are not read. Repeated keys give repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, folder)
        for batch in batches:
            offsets, ids = encoder.encode(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode_column(df: DataFrame, key: str = "doc_id", ids: str = "ids", tokenizer: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """``key, text``: the text of every list of ids; of a null list null, of an empty one the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, folder)
        for batch in batches:
            texts = [None if x is None else encoder.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(ids)).mapInArrow(run, f"`{key}` {kind}, text string")


def count_column(df: DataFrame, key: str, text: str, tokenizer: str, folder: str = VOCABULARIES) -> DataFrame:
    """``key, n_tokens``; as :func:`encode_column`, with the ids counted where they arise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, folder)
        for batch in batches:
            offsets, _ = encoder.encode(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets))], names=[key, "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint")


def round_trip(documents: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, intact``: whether a document's ids decode to its exact text (a null one to the empty text)."""
    ids = encode_column(documents)
    back = decode_column(ids).select("doc_id", F.xxhash64("text").alias("back")).groupBy("doc_id", "back").count()
    sizes = ids.select("doc_id", F.size("ids").alias("n_tokens"))
    texts = documents.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n"))
    met = texts.join(back.select("doc_id", F.col("back").alias("h"), F.col("count").alias("m")), ["doc_id", "h"], "left")
    intact = met.groupBy("doc_id").agg((F.sum(F.coalesce("m", F.lit(0))) == F.sum("n")).alias("intact"))
    return sizes.join(intact, "doc_id")
