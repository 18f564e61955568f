"""Skew-safe sequential operators.

A plain window sends all rows of a key to one task. Here every key is cut into
chunks along the order column, windows run inside a chunk, and only one summary row
per (key, chunk) travels to the window over the whole key. A key that holds a third
of the table is so spread over as many tasks as it has chunks.

Rows and summaries come from one scan and one shuffle of the rows: the summary is made of the
same shuffled rows, all their columns included, so that Spark finds both branches alike and
reads the exchange a second time instead of the input.

``chunk`` is any column that never decreases along the order (the hour of a
timestamp, ``ordinal div n``); it has to be an expression of the row alone, so that
both uses of it agree even if a task is run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLOCK = "_block"


def ordinal_chunk(order: str, rows: int = 65536) -> Column:
    return F.floor(F.col(order) / F.lit(rows))


def _block(keys: list[str], chunk: Column) -> Column:
    # a struct is never NULL and compares NULL fields as equal, so rows without a key
    # form a group of their own and the joins below need no NULL-safe condition
    return F.struct(F.struct(*keys).alias("k"), chunk.alias("c"))


def _summary(local: DataFrame, columns: list[str], *parts: Column) -> DataFrame:
    """One row per block. A checksum of all columns keeps them in this branch; without it Spark
    would leave out what the summary does not need, and could not reuse the rows' exchange."""
    whole = F.bit_xor(F.xxhash64(*[F.col(f"`{c}`") for c in columns])).alias("_whole")
    return local.groupBy(_BLOCK).agg(*parts, whole).where("_whole IS NOT NULL").drop("_whole")


def _carry(blocks: DataFrame, value: Column) -> DataFrame:
    """Per block, ``value`` over the earlier blocks of the same key; blocks without one left out."""
    return blocks.select(_BLOCK, value.alias("_carry")).where(F.col("_carry").isNotNull())


def lag_in_key(
    df: DataFrame, keys: list[str], order: list[str], columns: list[str], chunk: Column,
    prefix: str = "prev_",
) -> DataFrame:
    """Add the previous row's ``columns`` within ``keys`` along ``order``, plus ``has_prev``."""
    base = df.withColumn(_BLOCK, _block(keys, chunk))
    inside = Window.partitionBy(_BLOCK).orderBy(*order)
    row = F.struct(*columns)
    lagged = base.withColumn("_prev", F.lag(row).over(inside)).withColumn(
        "_first", F.row_number().over(inside) == 1
    )
    # last row of each block, handed to the next block of the same key
    ends = _summary(lagged, [*df.columns, "_prev", "_first"], F.max_by(row, F.struct(*order)).alias("_end"))
    along = Window.partitionBy(f"{_BLOCK}.k").orderBy(f"{_BLOCK}.c")
    joined = lagged.join(_carry(ends, F.lag("_end").over(along)), _BLOCK, "left")
    previous = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev"))
    return joined.withColumn("_prev", previous).select(
        *df.columns,
        *[F.col(f"_prev.{c}").alias(prefix + c) for c in columns],
        F.col("_prev").isNotNull().alias("has_prev"),
    )


def _runs(
    df: DataFrame, keys: list[str], order: list[str], run_key: str, chunk: Column, columns: list[str]
) -> DataFrame:
    """``columns`` of ``df`` with ``_block`` and ``run_start``. Rows are shuffled once, by block;
    the rest works on one summary row per block."""
    kept = df.where(F.col(run_key).isNotNull()).select(*[F.col(f"`{c}`") for c in columns], _block(keys, chunk).alias(_BLOCK))
    at, key = F.struct(*order), F.col(run_key)
    inside = Window.partitionBy(_BLOCK).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # starts seen inside the block; its first row is settled by the summary below
    local = kept.withColumn(
        "_mark", F.when(F.lag(key).over(inside) != key, at)
    ).withColumn("_here", F.last("_mark", ignorenulls=True).over(upto))

    summary = _summary(
        local, columns,
        F.min_by(key, at).alias("_first"), F.max_by(key, at).alias("_last"),
        F.min(at).alias("_at"), F.max("_mark").alias("_inner"),
    )
    # columns of their own, so that both windows share one exchange
    along = Window.partitionBy("_k").orderBy("_c")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce(F.col("_before") != F.col("_first"), F.lit(True))
    entry = (
        summary.select("*", F.col(f"{_BLOCK}.k").alias("_k"), F.col(f"{_BLOCK}.c").alias("_c"))
        .withColumn("_before", F.lag("_last").over(along))
        .withColumn("_opens", F.when(opens, F.col("_at")))
        .withColumn("_carry", F.max(F.coalesce("_inner", "_opens")).over(before))
        .select(_BLOCK, F.coalesce("_opens", "_carry").alias("_entry"))
    )
    return local.join(entry, _BLOCK).withColumn("run_start", F.coalesce("_here", "_entry"))


def para_runs(
    df: DataFrame, keys: list[str], order: list[str], run_key: str, chunk: Column
) -> DataFrame:
    """Number the runs of equal, consecutive ``run_key`` by the order value they start at.

    Rows without a run key are dropped first, so they do not break a run.
    Adds ``run_start`` (a struct of the order columns).
    """
    return _runs(df, keys, order, run_key, chunk, df.columns).select(*df.columns, "run_start")


def merge_same_para(
    df: DataFrame, keys: list[str], order: list[str], run_key: str, text: str, chunk: Column,
    firsts: list[str] = (), separator: str = " ",
) -> DataFrame:
    """One row per run: texts joined in order, ``firsts`` taken from its first row.

    Texts are joined per block first, where the rows already are, then across blocks.
    """
    runs = _runs(df, keys, order, run_key, chunk, list(dict.fromkeys([*keys, *order, run_key, text, *firsts])))
    at = F.struct(*order)
    by_run = [*keys, run_key, "run_start"]
    parts = runs.groupBy(_BLOCK, *by_run).agg(
        F.sort_array(F.collect_list(F.struct(at.alias("at"), F.coalesce(F.col(text), F.lit("")).alias("t")))).alias("_p"),
        F.min_by(F.struct(F.lit(1).alias("_one"), *firsts), at).alias("_f"),
        F.count("*").alias("_n"),
    ).select(
        *by_run, F.col(f"{_BLOCK}.c").alias("_c"), "_f", "_n",
        F.array_join(F.col("_p.t"), separator).alias("_t"),
    )
    merged = parts.groupBy(*by_run).agg(
        F.sort_array(F.collect_list(F.struct("_c", "_t"))).alias("_p"),
        F.min_by("_f", "_c").alias("_f"),
        F.sum("_n").alias("merged_rows"),
    )
    return merged.select(
        *by_run,
        *[F.col(f"_f.{c}").alias(c) for c in firsts],
        F.array_join(F.col("_p._t"), separator).alias(text),
        "merged_rows",
    )
