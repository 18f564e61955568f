"""Filters and projections. Every predicate is a plain expression, so it reaches the scan."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemicycle.functions import text as tx


def filter_term(df: DataFrame, column: str, value: object) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def filter_and(df: DataFrame, *predicates: Column | None) -> DataFrame:
    """All predicates hold; an optional predicate may be None."""
    given = [p for p in predicates if p is not None]
    return df.where(reduce(and_, given)) if given else df


def filter_or(df: DataFrame, *predicates: Column) -> DataFrame:
    return df.where(reduce(or_, predicates))


def filter_exists(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull())


def filter_missing(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def filter_blank_text(df: DataFrame, column: str) -> DataFrame:
    """Rows without text: NULL, blank, or a list holding only blanks (or nothing)."""
    if df.schema[column].dataType.typeName() == "array":
        blank = F.col(column).isNull() | F.forall(column, tx.is_blank)
    else:
        blank = tx.is_blank(F.col(column))
    return df.where(blank)


def filter_list_text(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text was stored as a JSON list."""
    return df.where(tx.json_list_test(F.col(column)))


def filter_vote(df: DataFrame, column: str = "vote_present") -> DataFrame:
    return df.where(F.col(column))


def filter_nonblank(df: DataFrame, column: str) -> DataFrame:
    return df.where(~tx.is_blank(F.col(column)))


def filter_min_length(df: DataFrame, column: str, longer_than: int = 10) -> DataFrame:
    return df.where(F.length(column) > longer_than)


def filter_group_in(df: DataFrame, column: str, groups: list) -> DataFrame:
    return df.where(F.col(column).isin(*groups))


def filter_years(df: DataFrame, years: list[int], column: str = "annee") -> DataFrame:
    """Rows of the given years; a year the table lacks adds nothing."""
    return df.where(F.col(column).isin(*years))


def drop_null_date(df: DataFrame, column: str = "date_seance") -> DataFrame:
    return df.dropna(subset=[column])


def point_lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row with this key. A missing key raises when the result is read."""
    hit = df.where(F.col(key) == F.lit(value))
    absent = F.raise_error(F.lit(f"no row with {key} = {value}"))
    # a row that exists, and so raises, only when nothing was found
    nothing = hit.agg(F.count("*").alias("_n")).where(F.col("_n") == 0)
    return hit.unionByName(nothing.select(*[
        absent.cast(f.dataType).alias(f.name) for f in df.schema.fields
    ]))


def project_include(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns)


def project_exclude(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*columns)


def project_defaults(
    df: DataFrame, defaults: dict[str, tuple[str, str]], fill_null: bool = False
) -> DataFrame:
    """``{output: (input, default)}``: a column that is absent becomes its default.

    A present NULL stays NULL unless ``fill_null``.
    """
    out = []
    for name, (source, default) in defaults.items():
        if source not in df.columns:
            out.append(F.lit(default).alias(name))
        elif fill_null:
            out.append(F.coalesce(F.col(source), F.lit(default)).alias(name))
        else:
            out.append(F.col(source).alias(name))
    return df.select(*out)


def scan_year_texts(df: DataFrame, year: int, text: str = "texte", column: str = "annee") -> DataFrame:
    """Non-blank texts of one year; on a table partitioned by year this prunes partitions."""
    return filter_nonblank(filter_term(df, column, year), text)


def first_n_texts(df: DataFrame, text: str, order: list[str], n: int = 1000) -> DataFrame:
    """The first ``n`` non-null texts along ``order`` (a sampling operator)."""
    return df.where(F.col(text).isNotNull()).orderBy(*order).limit(n)


def result_cap(df: DataFrame, order: list, cap: int | None = None) -> DataFrame:
    """Optional cap on the number of rows; none unless asked for."""
    return df if cap is None else df.orderBy(*order).limit(cap)
