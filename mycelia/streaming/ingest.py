"""Continuous ingest: files dropped into a folder are parsed and folded into the stored edges, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mycelia.operators.graph import lemma_edges, ticked
from mycelia.sources.files import FILE_SCHEMA, Reader, parse, sentences_in_order


def watch(spark: SparkSession, folder: str, archive: str | None = None) -> DataFrame:
    """New files directly inside ``folder`` as a stream; with ``archive``, completed ones are moved there."""
    source = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "false")
    if archive:
        source = source.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return source.load(folder)


def merge_batch(files: DataFrame, batch: int, store: str, readers: dict[str, Reader] | None = None) -> None:
    """Fold one micro-batch into ``store``: its edges go to a folder of their own, named by the batch.

    A batch that is delivered again overwrites its own folder, so nothing is counted twice; :func:`edges` folds the
    folders when the graph is read. Files that fail are rows of ``store/dead_letters``.
    """
    elements = parse(files, readers).persist()
    rows = ticked(sentences_in_order(elements))
    folded = lemma_edges(rows).select("src", "dst", "dep_type", "repetitions", F.col("last_op").alias("op"))
    folded.write.mode("overwrite").parquet(f"{store}/edges/batch={batch}")
    rows.agg(F.count(F.lit(1)).alias("sentences")).write.mode("overwrite").parquet(f"{store}/clock/batch={batch}")
    elements.where("type = 'error'").select("path", "error").write.mode("overwrite").parquet(f"{store}/dead_letters/batch={batch}")
    elements.unpersist()


def start(spark: SparkSession, folder: str, store: str, checkpoint: str, archive: str | None = None, readers: dict[str, Reader] | None = None, once: bool = False) -> StreamingQuery:
    """The running query; ``once`` takes what is there and stops."""
    writer = watch(spark, folder, archive).writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: merge_batch(df, i, store, readers))
    return (writer.trigger(availableNow=True) if once else writer).start()


def edges(spark: SparkSession, store: str) -> DataFrame:
    """``src, dst, dep_type, repetitions, last_op`` over all batches; the clock ticks once per sentence, the batches' sentences follow one another."""
    clocks = spark.read.parquet(f"{store}/clock")  # one row a batch
    before = F.coalesce(F.sum("sentences").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = spark.read.parquet(f"{store}/edges").join(clocks.select("batch", before.alias("before")), "batch")
    return rows.groupBy("src", "dst", "dep_type").agg(F.sum("repetitions").alias("repetitions"), F.max(F.col("before") + F.col("op")).alias("last_op"))


def compact(spark: SparkSession, store: str, into: str) -> None:
    """Fold all batches of ``store`` into the one batch of a new store, so that reading does not slow down with their number."""
    sentences = spark.read.parquet(f"{store}/clock").agg(F.sum("sentences").alias("sentences"))
    edges(spark, store).withColumnRenamed("last_op", "op").write.mode("overwrite").parquet(f"{into}/edges/batch=0")
    sentences.write.mode("overwrite").parquet(f"{into}/clock/batch=0")
