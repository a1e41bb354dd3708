"""Records put back into the order of their files, one file at a time, without a group in memory but the file at hand."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mycelia.operators.numbering import dense_number

#: A file of more records is taken in stretches of so many. Each sees ``OVERLAP`` records of its neighbours as well, which it reports nothing of.
STRETCH, OVERLAP = 5000, 100


def file_rows(sentence_data: DataFrame, suffix: str) -> DataFrame:
    """``rec_id, file_path, stretch, own, source, text`` of the records whose path ends in ``suffix`` (any case), sorted by file within partitions.

    Records without a key are left out; repeated ones stand beside each other and are dropped while reading. A file that holds a
    large share of all rows is dealt out by the place of its records in it, so no task gets it whole. Records near a border are
    given to both sides, to one of them as its ``own``: a divided word, a page or a running title that goes on over the border is seen whole.
    """
    columns = ["rec_id", "file_path", "source", "text"]
    rows = sentence_data.where(F.col("rec_id").isNotNull() & F.lower("file_path").endswith(suffix)).select(*columns)
    sizes = rows.groupBy("file_path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > STRETCH).select("file_path")
    large = rows.join(sizes, "file_path", "left_semi").dropDuplicates(["rec_id"])
    if large.isEmpty():
        dealt = rows.withColumn("stretch", F.lit(0).cast("long")).withColumn("own", F.lit(True))
    else:
        placed = dense_number(large.select("file_path", "rec_id"), ["file_path", "rec_id"], "place")
        first = placed.groupBy("file_path").agg(F.min("place").alias("first"))
        at = placed.join(first, "file_path").select("rec_id", (F.col("place") - F.col("first")).alias("at"))
        home = F.floor(F.col("at") / STRETCH)
        near = F.array(F.floor((F.col("at") - OVERLAP) / STRETCH), home, F.floor((F.col("at") + OVERLAP) / STRETCH))
        spread = large.join(at, "rec_id").withColumn("home", home).select(*columns, "home", F.explode(F.array_distinct(near)).alias("stretch")).where("stretch >= 0")
        dealt = rows.join(sizes, "file_path", "left_anti").select(*columns, F.lit(0).cast("long").alias("stretch"), F.lit(True).alias("own"))
        dealt = dealt.unionByName(spread.select(*columns, "stretch", (F.col("stretch") == F.col("home")).alias("own")))
    return dealt.select("rec_id", "file_path", "stretch", "own", "source", "text").repartition("file_path", "stretch").sortWithinPartitions("file_path", "stretch", "rec_id")


def by_file(per_file: Callable[[list[tuple]], list[tuple]], columns: list[str], extra: tuple[str, ...] = ()) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A ``mapInPandas`` function over :func:`file_rows`: calls ``per_file`` with the ``(rec_id, source, text, *extra)`` of each file in order.

    If the rows of ``per_file`` begin with a ``rec_id``, those of records that are not the stretch's own are dropped.
    """
    keyed = columns[0] == "rec_id"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, records, foreign = None, [], set()

        def done() -> list[tuple]:
            if len(foreign) == len(records):  # a neighbour beyond the last record
                return []
            found = per_file(records) if keyed or not foreign else per_file([r for r in records if r[0] not in foreign])
            return [row for row in found if row[0] not in foreign] if keyed and foreign else found

        for batch in batches:
            out: list[tuple] = []
            keys = zip(batch["file_path"], batch["stretch"], strict=True)
            values = zip(batch["rec_id"], batch["source"], batch["text"], *(batch[c] for c in extra), strict=True)
            for key, own, record in zip(keys, batch["own"], values, strict=True):
                if key != path:
                    if records:
                        out += done()
                    path, records, foreign = key, [], set()
                if not records or record[0] != records[-1][0]:
                    records.append(record)
                    if not own:
                        foreign.add(record[0])
            yield pd.DataFrame(out, columns=columns)
        if records:
            yield pd.DataFrame(done(), columns=columns)

    return run
