"""Vectors of texts, kept beside the table and maintained by change.

The side table holds one row per (key, digest of the text): its vector. An update computes
vectors only for texts whose digest is not there, so a second run computes nothing and a
changed text only itself. The table is versioned like any other (:mod:`table`), in parts by
hash of the key, and an update rewrites only the parts it touches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hemicycle.functions import text as tx
from hemicycle.operators.joins import latest_per_key
from hemicycle.operators.vectors import embed_texts
from hemicycle.sources import table

PART, PARTS = "part", 64
VECTORS = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("digest", T.StringType()),
    T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField(PART, T.IntegerType()),
])
Embed = Callable[[DataFrame, str, str], DataFrame]


def _digests(rows: DataFrame, key: str, text: str) -> list[Column]:
    return [F.col(key).cast("string").alias("key"), F.sha2(F.col(text), 256).alias("digest")]


def stored_vectors(spark: SparkSession, path: str) -> DataFrame:
    return table.read_table(spark, path, VECTORS)


def update_vectors(rows: DataFrame, path: str, key: str, text: str, embed: Embed = embed_texts) -> int:
    """Compute and store the vectors that are missing; how many there were.

    Blank texts and rows without a key have no vector; of rows of one key the least digest
    counts. Keys and digests alone are met with the side table; only texts that need a vector
    go on to the model.
    """
    spark = rows.sparkSession
    if not table.table_exists(path):
        table.create_table(spark, path, VECTORS, PART)
    wanted = rows.where(F.col(key).isNotNull() & ~tx.is_blank(F.col(text))).select(*_digests(rows, key, text), F.col(text).alias("text"))
    known = stored_vectors(spark, path).select("key", "digest")
    todo = latest_per_key(wanted, ["key"], [F.asc("digest")]).join(known, ["key", "digest"], "left_anti")
    part = F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int")
    fresh = embed(todo, "text", "vector").select(
        "key", "digest", F.col("vector").cast("array<float>").alias("vector"), part.alias(PART))
    with table.Staged(fresh, "vectors") as staged:
        n = staged.count()
        if n:
            table.upsert_by_key(staged, path, "key", ["digest"], VECTORS, PART, stage=False)
        return n


def with_vectors(rows: DataFrame, path: str, key: str, text: str, out: str = "texte_embedding") -> DataFrame:
    """The rows with the stored vector of their present text; NULL where there is none."""
    stored = stored_vectors(rows.sparkSession, path).select(
        F.col("key").alias("_key"), F.col("digest").alias("_digest"), F.col("vector").alias(out))
    mine = rows.drop(out).withColumns({"_key": F.col(key).cast("string"), "_digest": F.sha2(F.col(text), 256)})
    return mine.join(stored, ["_key", "_digest"], "left").drop("_key", "_digest")
