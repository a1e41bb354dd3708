"""Documents from folders: reading, dispatch by suffix, parsing into elements, and what became of each file."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mycelia.functions.text import not_blank, suffix
from mycelia.operators.numbering import dense_number
from mycelia.schemas import SENTENCE

#: Which reader takes a suffix; everything else is read as plain text. Fixed values.
READERS = {".pdf": "pdf", ".html": "html"}
FILE_SCHEMA = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())]
)
ELEMENTS = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("type", T.StringType()), T.StructField("content", SENTENCE), T.StructField("error", T.StringType())]
)
#: Labels given in turn by the built-in parser. It is no linguistic parse.
BUILT_IN_LABELS = ("det", "amod", "nsubj", "prep", "dobj", "advmod", "conj")

Reader = Callable[[bytes], str]


def reader_of(path: Column) -> Column:
    case = None
    for s, name in READERS.items():
        case = F.when(suffix(path) == s, name) if case is None else case.when(suffix(path) == s, name)
    return case.otherwise("auto")


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """The regular files directly inside ``folder`` (or one file) as ``path, modificationTime, length, content``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles and tags removed, the five common entities decoded."""
    text = F.regexp_replace(html, "(?is)<(script|style)\\b.*?</\\1\\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(text, "(?i)<(?:br|/p|/div|/h[1-6]|/li|/tr)\\b[^>]*>", "\n")
    text = F.regexp_replace(text, "<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def built_in_sentences(text: Column) -> Column:
    """``array<struct<text, tokens>>`` by rule: cut at ends and line breaks, split at blanks and commas, each token headed by the next."""
    parts = F.filter(F.split(F.lower(text), "[.!?\n]+"), lambda s: s.rlike("[^\\s\\p{Z},;:]"))

    def sentence(s: Column) -> Column:
        words = F.filter(F.split(s, "[ ,;:\t\r]+"), lambda w: F.length(w) > 0)
        labels = F.array(*[F.lit(x) for x in BUILT_IN_LABELS])
        tokens = F.transform(
            words,
            lambda w, i: F.struct(
                w.alias("lemma"),
                F.when(i == F.size(words) - 1, "ROOT").otherwise(F.get(labels, (F.length(w) % len(BUILT_IN_LABELS)).cast("int"))).alias("dep"),
                F.when(i == F.size(words) - 1, 0).otherwise(1).cast("int").alias("head_offset"),
            ),
        )
        return F.struct(F.trim(s).alias("text"), tokens.alias("tokens"))

    return F.transform(parts, sentence)


def parse(files: DataFrame, readers: dict[str, Reader] | None = None) -> DataFrame:
    """``path, position, type, content, error``: the sentences of every file, one element each, by their place in it from 0.

    ``readers`` maps a reader's name to a function from bytes to text, run once per batch in Python; without one, text and
    pages are read by expressions and a ``pdf`` is an error. A file that cannot be read gives one row of type ``error``; a blank one none.
    """
    name = reader_of(F.col("path"))
    if readers:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                texts, errors = [], []
                for kind, content in zip(batch["reader"], batch["content"], strict=True):
                    try:
                        texts.append(readers.get(kind, readers.get("auto", lambda b: b.decode("utf-8")))(content))
                        errors.append(None)
                    except Exception as e:  # noqa: BLE001  (whatever a reader raises belongs to its file)
                        texts.append(None)
                        errors.append(f"{type(e).__name__}: {e}"[:500])
                yield pd.DataFrame({"path": batch["path"], "text": texts, "error": errors})

        texts = files.select("path", name.alias("reader"), "content").mapInPandas(run, "path string, text string, error string")
    else:
        raw = F.try_validate_utf8(F.col("content").cast("string"))
        text = F.when(name == "html", html_text(raw)).when(name == "auto", raw)
        error = F.when(name == "pdf", "no reader for pdf").when(raw.isNull(), "not valid UTF-8")
        texts = files.select("path", text.alias("text"), error.alias("error"))
    good = texts.where(F.col("error").isNull() & not_blank(F.col("text"))).select("path", F.posexplode(built_in_sentences(F.col("text"))).alias("position", "content"))
    bad = texts.where(F.col("error").isNotNull()).select("path", F.lit(0).alias("position"), F.lit("error").alias("type"), F.lit(None).cast(SENTENCE).alias("content"), "error")
    return good.select("path", "position", F.lit("text").alias("type"), F.col("content").cast(SENTENCE).alias("content"), F.lit(None).cast("string").alias("error")).unionByName(bad)


def sentences_in_order(elements: DataFrame) -> DataFrame:
    """``sent_id, tokens``: the sentences of parsed files, numbered from 1 by path and place. A sentence that occurs twice is two sentences."""
    rows = elements.where("type = 'text'").select("path", "position", F.col("content.tokens").alias("tokens"))
    return dense_number(rows, ["path", "position"], "sent_id", start=1).select("sent_id", "tokens")


def outcomes(files: DataFrame, elements: DataFrame) -> DataFrame:
    """``path, status, n_sentences``: ``failed``, ``empty`` (still a success) or ``success`` of every file."""
    per = elements.groupBy("path").agg(F.sum((F.col("type") == "text").cast("long")).alias("n"), F.max(F.col("type") == "error").alias("bad"))
    n = F.coalesce("n", F.lit(0))
    return files.select("path").join(per, "path", "left").select("path", F.when(F.coalesce("bad", F.lit(False)), "failed").when(n == 0, "empty").otherwise("success").alias("status"), n.alias("n_sentences"))


def archive_state(file_event: DataFrame) -> DataFrame:
    """``file_path, archived``: the state of each path by its latest event (then the greater event id); repeated events count once."""
    rows = file_event.where("file_path IS NOT NULL AND event_id IS NOT NULL")
    return rows.groupBy("file_path").agg(F.max_by("archived", F.struct("seen_at", "event_id")).alias("archived"))
