"""Connected components of a link table, by alternating large-star and small-star steps.

Each step groups links by node, so its shuffles follow the number of links, but for hubs, whose
many links stay where they are; a step's result
is cut to the shared folder. The number of rounds grows with the logarithm of the longest
path; between the steps each task joins what its own links connect, at most ``PIECE`` at a time,
so that most components need few of them. Nothing but three numbers per round reaches the driver.

Links are few next to the documents they come from: they are read by one task a core, or one
for every ``PIECE`` links if those are more, since the driver keeps a record of every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from hemicycle.llm.common import BROADCAST_ROWS, cut

#: Links of a node beyond which its neighbours are told its minimum by broadcast. There is at
#: most one such node for every HUB links.
HUB = 1000
#: Links that a task holds at a time.
PIECE = 1 << 16


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that each of ``n`` numbers reaches through links of ``a`` and ``b``."""
    root = np.arange(n)
    while (root[a] != root[b]).any():
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return root


def local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function over links (a, b) of whole numbers, or of arrays of equally many: links of
    each node to the least that it reaches through the links held, which are ``PIECE`` and a batch.
    Links of other nodes go on as they are."""
    kind, width, held = None, None, None

    def numbers(column: pa.Array) -> np.ndarray | None:
        flat, n = column, {1}
        if pa.types.is_list(column.type):
            flat, n = column.flatten(), set(pc.list_value_length(column).to_pylist())
        if len(n) > 1 or not pa.types.is_integer(flat.type) or flat.null_count or column.null_count or 0 in n:
            return None
        return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def given(links: np.ndarray) -> pa.RecordBatch:
        sides = [pa.array(np.ascontiguousarray(links[:, i]).ravel()) for i in (0, 1)]
        if pa.types.is_list(kind):
            ends = pa.array(np.arange(len(links) + 1, dtype=np.int32) * width)
            sides = [pa.ListArray.from_arrays(ends, side) for side in sides]
        return pa.RecordBatch.from_arrays(sides, ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = numbers(batch.column(0)), numbers(batch.column(1))
        if a is None or b is None or a.shape != b.shape or a.shape[1] != (width or a.shape[1]):
            yield batch
            continue
        kind, width = batch.column(0).type, a.shape[1]
        links = np.stack([a, b], axis=1)
        links = links if held is None else np.concatenate([held, links])
        nodes, number = np.unique(links.reshape(-1, width), axis=0, return_inverse=True)
        number = number.reshape(-1, 2)
        root = roots(len(nodes), number[:, 0], number[:, 1])
        below = np.flatnonzero(root != np.arange(len(nodes)))
        held = np.stack([nodes[below], nodes[root[below]]], axis=1)
        if len(held) > PIECE:
            yield given(held)
            held = None
    if held is not None and len(held):
        yield given(held)


def gathered(links: DataFrame, n: int = 0) -> DataFrame:
    """``links``, or what is made of them, ``n`` rows, by as few tasks as keep all cores at work."""
    tasks = max(links.sparkSession.sparkContext.defaultParallelism, -(-n // PIECE))
    return links.coalesce(tasks)


def contracted(links: DataFrame, n: int = 0) -> DataFrame:
    """Links that connect the same nodes, fewer of them: stars where a task has all links."""
    return cut(gathered(links, n).mapInArrow(local_stars, links.schema))


def state(links: DataFrame, n: int = 0) -> Row:
    """Of links (a, b) with a > b, some ``n`` of them: ``n`` links, ``hubs`` of over ``HUB`` of them, and nodes that are ``open``,
    in links to two smaller nodes or to smaller and larger ones. Where none is, all links
    lead to the least node of their component."""
    ends = F.array(
        F.struct(F.col("a").alias("node"), F.col("b").alias("below")),
        F.struct(F.col("b").alias("node"), F.lit(None).cast(links.schema["b"].dataType).alias("below")))
    nodes = gathered(links.select(F.inline(ends)).groupBy("node").agg(
        F.count("*").alias("links"), F.count("below").alias("downward"),
        (F.min("below") != F.max("below")).alias("two")), 2 * n)
    is_open = (F.col("downward") > 0) & (F.col("two") | (F.col("links") > F.col("downward")))
    return nodes.agg(
        F.coalesce(F.sum("downward"), F.lit(0)).alias("n"), F.count_if(F.col("links") > HUB).alias("hubs"),
        F.count_if(is_open).alias("open")).first()


def stars(links: DataFrame, hubs: int | None = None, n: int = 0) -> DataFrame:
    """One large-star and one small-star step on (a, b) with a > b, ``n`` and ``hubs`` if known."""
    turned = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    both = links.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    # stored: a join with a table, not with sums, has its large partitions split
    least = cut(gathered(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select(
        "a", F.least("a", "m").alias("m"), "n"), 2 * n))
    if hubs == 0:
        told = turned.join(least, "a").select("b", "m")
    else:
        # a hub's neighbours are not gathered: they get the hub's minimum where they are
        top = least.where(F.col("n") > HUB).select("a", F.col("m").alias("hub"))
        if hubs is not None and hubs <= BROADCAST_ROWS:
            top = F.broadcast(top)
        upward = turned.join(top, "a", "left")
        told = upward.where("hub IS NULL").join(least.where(F.col("n") <= HUB), "a").select("b", "m").unionByName(
            upward.where("hub IS NOT NULL").select("b", F.col("hub").alias("m")))
    large = cut(gathered(told.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b"), n))
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    # the link to the least neighbour stays, those to others go from there to the least
    return large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
                                       F.col("m").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """(node, root): for every node of a link (a, b), the smallest node it reaches."""
    now = contracted(cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))))
    at = state(now)
    while at.open:
        now = contracted(cut(gathered(stars(now, at.hubs, at.n), at.n)), at.n)
        at = state(now, at.n)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
