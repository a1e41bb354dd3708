"""Readers of the parquet tables, and the rule that a repeated key counts once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(df: DataFrame, key: str) -> DataFrame:
    """One row per non-null ``key``; repeated rows are exact copies, so any of them will do.

    Rows without a key cannot be reported on and are left out.
    """
    return df.where(F.col(key).isNotNull()).dropDuplicates([key])
