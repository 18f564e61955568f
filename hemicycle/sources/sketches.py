"""Counts per year that add up: documents and distinct keys, stored as mergeable sketches.

Each load adds one row per year: its documents and a HyperLogLog sketch of its keys. Reading
sums the documents and unites the sketches, so a new load never reads the rows of older ones.
The table is versioned like any other (:mod:`table`); a load that is added again under the same
name changes nothing. Rows without a year are a group of their own, null keys are not counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hemicycle.sources import table

#: Registers of a sketch, as a power of two: 2**14 err by about 1 %.
PRECISION = 14
COUNTS = T.StructType([
    T.StructField("part", T.StringType()), T.StructField("documents", T.LongType()),
    T.StructField("sketch", T.BinaryType()), T.StructField(table.YEAR, T.IntegerType()),
])


def sketched(rows: DataFrame, key: Column, *by: str) -> DataFrame:
    """Documents and the sketch of their keys per group; sketches are made before the shuffle."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("documents"), F.hll_sketch_agg(key, F.lit(PRECISION)).alias("sketch"))


def add_load(rows: DataFrame, path: str, load: str, key: Column, year: str = table.YEAR) -> None:
    """Add the counts of one load, known by its name."""
    if not table.table_exists(path):
        table.create_table(rows.sparkSession, path, COUNTS, table.YEAR)
    counts = sketched(rows.select(F.col(year).cast("int").alias(table.YEAR), key.alias("key")), F.col("key"), table.YEAR)
    named = counts.withColumn("part", F.concat(F.lit(f"{load}:"), F.coalesce(F.col(table.YEAR).cast("string"), F.lit(""))))
    table.insert_if_absent(named, path, "part", ["documents"], COUNTS, table.YEAR)


def _united(parts: DataFrame, *by: str) -> DataFrame:
    return parts.groupBy(*by).agg(
        F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).alias("distinct_keys"))


def stored_by_year(spark: SparkSession, path: str) -> DataFrame:
    """(annee, documents, distinct_keys), from the stored rows alone."""
    return _united(table.read_table(spark, path, COUNTS), table.YEAR)


def stored_total(spark: SparkSession, path: str, years: list[int] | None = None) -> DataFrame:
    """(documents, distinct_keys) over all years or some: a key of several years counts once."""
    parts = table.read_table(spark, path, COUNTS)
    return _united(parts if years is None else parts.where(F.col(table.YEAR).isin(*years)))
