"""Sorts, limits and top-k. Each has a total order, and runs as a per-task top-k first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hemicycle.functions import text as tx
from hemicycle.operators import joins, search

# Themes searched one after the other.
THEMES = ("insécurité", "sécurité", "délinquance", "criminalité", "violence")


def latest_sample(df: DataFrame, date: str, key: str, n: int = 3) -> DataFrame:
    return df.orderBy(F.col(date).desc_nulls_last(), key).limit(n)


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """Most frequent values of a column, ties by value."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), column).limit(n)


def top_speakers(df: DataFrame, speaker: str, n: int = 10) -> DataFrame:
    return top_values(df, speaker, n)


def lowest_by_column(
    df: DataFrame, score: Column, key: str, n: int = 10, where: Column | None = None
) -> DataFrame:
    rows = df if where is None else df.where(where)
    return rows.withColumn("score", score).orderBy(F.col("score").asc_nulls_last(), key).limit(n)


def worst_by_group(
    df: DataFrame, group: str, value: object, score: Column, key: str,
    texts: DataFrame, text: str, text_key: str, n: int = 10,
) -> DataFrame:
    """The lowest-scored rows of one group, with their texts looked up afterwards."""
    worst = lowest_by_column(df, score, key, n, F.col(group) == F.lit(value))
    return joins.lookup_field(worst, texts, key, text, table_key=text_key)


def theme_hits(df: DataFrame, themes: tuple[str, ...], text: str, mode: str = search.FRENCH) -> DataFrame:
    """One row per text and theme that it has a word of, without the text. One pass over the
    texts for all themes."""
    marked = search.bind(df, "_tokens", search.tokens_of(F.col(text), mode))
    hits = F.array_compact(F.array(*[F.when(search.any_word(F.col("_tokens"), t, mode), F.lit(t)) for t in themes]))
    return marked.withColumn("theme", F.explode(hits)).drop("_tokens", text)


def newest_by_theme(hits: DataFrame, newest_first: list[Column], columns: list[str], size: int = 10) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("theme").orderBy(*newest_first))
    return hits.withColumn("rank", rank).where(F.col("rank") <= size).select("theme", "rank", *columns)


def search_theme(
    df: DataFrame, themes: tuple[str, ...], text: str, newest_first: list[Column],
    columns: list[str], size: int = 10, mode: str = search.FRENCH,
) -> DataFrame:
    """Per theme, the newest matching rows. The text itself is not among the ``columns``."""
    return newest_by_theme(theme_hits(df, themes, text, mode), newest_first, columns, size)


def first_missing(left: DataFrame, right: DataFrame, column: str, n: int = 20) -> DataFrame:
    """The first ``n`` ids of left that right lacks, each with the number not shown."""
    missing = left.select(column).subtract(right.select(column))
    total = missing.agg(F.count("*")).scalar()
    first = missing.orderBy(column).limit(n)
    return first.withColumn("_t", total).select(
        column, F.greatest(F.col("_t") - n, F.lit(0)).alias("not_shown")
    )


def first_errors(files: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    failed = files.where(F.col("status") == "failed")
    total = failed.agg(F.count("*")).scalar()
    first = failed.orderBy(*order).limit(n)
    return first.withColumn("_t", total).withColumn(
        "not_shown", F.greatest(F.col("_t") - n, F.lit(0))
    ).drop("_t")
