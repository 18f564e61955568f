"""Set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_ids(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def except_ids(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    return left.select(column).subtract(right.select(column))


def intersect_ids(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    return left.select(column).intersect(right.select(column))
