"""Helpers that several operators of this sub-package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemicycle.session import shared_dir

#: Rows up to which a side may be broadcast; its count is taken before the hint is given.
BROADCAST_ROWS = 100_000


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    The copy is reliable: a lost executor costs nothing that came before. Spark's cleaner
    removes it when the driver no longer refers to it (if so configured).
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def hinted(small: DataFrame) -> DataFrame:
    """Broadcast a side whose counted rows are within the bound; else leave it to Spark."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


#: Bytes of values up to which :func:`small_enough` allows a broadcast.
BROADCAST_BYTES = 64 << 20


def small_enough(side: DataFrame, *keys: str) -> DataFrame:
    """Broadcast a side whose counted bytes are within the bound; else leave the join to Spark.

    ``keys``: the columns of varying length; the rest of a row counts for 64 bytes.
    """
    size = F.coalesce(F.sum(sum((F.coalesce(F.octet_length(F.col(k).cast("string")), F.lit(0)) for k in keys), F.lit(64))), F.lit(0))
    return F.broadcast(side) if side.agg(size).first()[0] <= BROADCAST_BYTES else side


def text_of(column: Column | str) -> Column:
    """A text, with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


#: White space of the word rules: blank and the control characters 09 to 0D.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(column: Column | str) -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD))


def wanted(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the names the operator works with.

    Whatever else the table holds, clashing names included, is left behind here.
    """
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])
