"""Dense numbers in a global order, without bringing the rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mycelia.session import cut_lineage


def dense_number(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """``df`` with ``name``: the rank of each row by ``order`` (a unique key), from ``start``.

    Rows are range-partitioned and numbered within their range; the ranges' sizes (one row a partition) are summed up and added.
    """
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_range", before.alias("_before"))  # as many rows as there are shuffle partitions
    local = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    numbered = ranged.withColumn("_local", local).join(F.broadcast(offsets), "_range")
    return numbered.withColumn(name, (F.col("_before") + F.col("_local") - 1 + start).cast("long")).drop("_range", "_local", "_before")
