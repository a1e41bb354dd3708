"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

TOKEN = T.StructType([T.StructField("lemma", T.StringType()), T.StructField("dep", T.StringType()), T.StructField("head_offset", T.IntegerType())])
SENTENCE = T.StructType([T.StructField("text", T.StringType()), T.StructField("tokens", T.ArrayType(TOKEN))])

