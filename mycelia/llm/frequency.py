"""Occurrences and record counts of every distinct item, by heavy-light aggregation.

1. *Detect.* Every task folds its rows into at most ``HEAVY`` counters (frequent-items summary); the
   summaries are added up and the ``HEAVY`` largest items become the heavy list. Its size is bounded by
   the constant and not by the data, so it may travel with the tasks.
2. *Heavy.* Each task counts heavy items exactly in two local arrays (occurrences, records) and emits
   one row per heavy item it saw: the shuffle gets at most ``HEAVY`` rows per task for them.
3. *Light.* Every other item is shuffled with its counts per batch and summed.
4. Both tables are united. The heavy list only decides where an item is counted; counts are exact
   whatever it holds.

A repeated record key counts once; rows with a null key are left out. Null items are skipped, the
empty item is counted. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mycelia.plans.tables import once

#: Most heavy items, and counters of a task's summary.
HEAVY = 1024


def _flat(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The items of a list column and the row each belongs to; null rows and null items are skipped."""
    lists = column.cast(pa.large_list(column.type.value_type))
    rows = np.asarray(pc.list_parent_indices(lists))
    items = pc.list_flatten(lists)
    keep = pc.is_valid(items)
    return items.filter(keep), rows[np.asarray(keep)]


def _counts(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct items of a batch with their occurrences and records."""
    items, rows = _flat(column)
    coded = items.dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    n = len(coded.dictionary)
    pairs = np.unique(rows.astype(np.int64) * max(n, 1) + code) % max(n, 1)
    return coded.dictionary, np.bincount(code, minlength=n), np.bincount(pairs, minlength=n)


def heavy_items(lists: DataFrame) -> list[str]:
    """At most ``HEAVY`` items, taken from bounded summaries over all rows of ``lists`` (one column of string arrays)."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[str, int] = {}
        for batch in batches:
            items, occurrences, _ = _counts(batch.column(0))
            top = np.argsort(-occurrences, kind="stable")[:HEAVY]
            for item, n in zip(items.take(pa.array(top)).to_pylist(), occurrences[top].tolist(), strict=True):
                counters[item] = counters.get(item, 0) + n
            if len(counters) > HEAVY:  # the frequent-items rule: lower all counters by the one that falls out
                ranked = sorted(counters.values(), reverse=True)[HEAVY]
                counters = {k: v - ranked for k, v in counters.items() if v > ranked}
        yield pa.RecordBatch.from_arrays([pa.array(list(counters), pa.string()), pa.array(list(counters.values()), pa.int64())], names=["item", "n"])

    rows = lists.mapInArrow(summarise, "item string, n bigint").groupBy("item").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "item").limit(HEAVY).repartition(1)
    return [r.item for r in rows.collect()]


def heavy_counts(lists: DataFrame, heavy: list[str]) -> DataFrame:
    """``item, occurrences, records`` of the heavy items, by two local arrays a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = pa.array(heavy, pa.string())
        local = np.zeros((2, len(heavy)), np.int64)
        for batch in batches:
            items, occurrences, records = _counts(batch.column(0))
            at = np.asarray(pc.fill_null(pc.index_in(items.cast(pa.string()), index), -1))
            hit = at >= 0
            local[0, at[hit]] += occurrences[hit]
            local[1, at[hit]] += records[hit]
        seen = local[0] > 0
        yield pa.RecordBatch.from_arrays([index.filter(pa.array(seen)), pa.array(local[0, seen]), pa.array(local[1, seen])], names=["item", "occurrences", "records"])

    return _summed(lists.mapInArrow(count, "item string, occurrences bigint, records bigint"))


def light_counts(lists: DataFrame, heavy: list[str]) -> DataFrame:
    """The same of all other items, counted per batch and shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = pa.array(heavy, pa.string())
        for batch in batches:
            items, occurrences, records = _counts(batch.column(0))
            light = pc.invert(pc.is_in(items.cast(pa.string()), index))
            keep = np.asarray(light)
            yield pa.RecordBatch.from_arrays([items.filter(light).cast(pa.string()), pa.array(occurrences[keep]), pa.array(records[keep])], names=["item", "occurrences", "records"])

    return _summed(lists.mapInArrow(count, "item string, occurrences bigint, records bigint"))


def _summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy("item").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def item_counts(lists: DataFrame, heavy: list[str]) -> DataFrame:
    """``item, occurrences, records`` of all items of ``lists`` (one column of string arrays, one row per record): both count tables united."""
    return heavy_counts(lists, heavy).unionAll(light_counts(lists, heavy))


def marked(counts: DataFrame, total: int, rare_below: int = 3, common_above: float = 0.05) -> DataFrame:
    """``counts`` with ``mark``: ``rare`` below so many records, ``common`` above that share of ``total`` records, else null.

    An item that is both (a tiny table) is marked ``rare``.
    """
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > total * common_above, "common")
    return counts.withColumn("mark", mark)


def _total(rows: DataFrame) -> int:
    """The number of records, one number on the driver."""
    return rows.agg(F.count(F.lit(1))).first()[0]


def lemma_frequencies(sentence_data: DataFrame) -> DataFrame:
    """``item, occurrences, records, mark`` of every lemma, byte for byte, over records with at least one token."""
    rows = once(sentence_data.select("rec_id", F.col("tokens.lemma").alias("items")).where("size(items) > 0"), "rec_id").select("items")
    heavy = heavy_items(sentence_data.where("size(tokens) > 0").select("tokens.lemma"))
    return marked(item_counts(rows, heavy), _total(rows))


def counter_frequencies(graph_edge: DataFrame) -> DataFrame:
    """The same of ``repetition_counter`` as decimal text, over distinct ``edge_id``s with a counter."""
    value: Column = F.array(F.col("repetition_counter").cast("string")).alias("items")
    some = graph_edge.where("repetition_counter IS NOT NULL")
    rows = once(some.select("edge_id", value), "edge_id").select("items")
    heavy = heavy_items(some.select(value))
    return marked(item_counts(rows, heavy), _total(rows))


def all_counts(sentence_data: DataFrame, graph_edge: DataFrame) -> DataFrame:
    """``subject, item, occurrences, records, mark`` of every lemma and every counter; the mark is null where it is useful."""
    parts = [
        f.select(F.lit(subject).alias("subject"), "item", "occurrences", "records", "mark")
        for subject, f in (("lemma", lemma_frequencies(sentence_data)), ("repetition_counter", counter_frequencies(graph_edge)))
    ]
    return parts[0].unionAll(parts[1])


def marked_items(sentence_data: DataFrame, graph_edge: DataFrame) -> DataFrame:
    """``subject, item, mark`` of every item too rare or too common."""
    return all_counts(sentence_data, graph_edge).where("mark IS NOT NULL").select("subject", "item", "mark")
