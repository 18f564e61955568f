"""A stated query set against all rows, in blocks.

Vectors are dealt evenly and packed into blocks of at most ``INDEX_ROWS``, however the table is
cut, queries into blocks of at most ``QUERY_ROWS``. Both sides are dealt over a grid of (query slot, index
slot) cells and met by equality on the cell, so each pair of blocks is compared in one task
whose memory is two blocks; beyond ``MOST_TASKS`` cells a task meets several, one after the
other. Only the best rows of each pair leave it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INDEX_ROWS, QUERY_ROWS = 8192, 1024
#: Tasks that compare blocks, at most.
MOST_TASKS = 20_000
RESULT = "query_id long, vec_id long, score {kind}"

#: From ids and a float64 matrix, one block's payload.
Pack = Callable[[np.ndarray, np.ndarray], bytes]
#: From a query payload and an index payload: query ids, row ids, scores.
Meet = Callable[[bytes, bytes], tuple[np.ndarray, np.ndarray, np.ndarray | pa.Array]]


def finite(vector: Column) -> Column:
    """A vector that is neither null nor empty and has only finite components."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(good, F.lit(False))


def packer(pack: Pack, rows: int):
    """mapInArrow function: (id, vector) rows to (dim, payload) blocks of one dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            vectors = batch.column(1)
            sizes = np.diff(vectors.offsets.to_numpy())
            starts = vectors.offsets.to_numpy()[:-1]
            values = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
            dims, payloads = [], []
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                at = at[np.argsort(ids[at], kind="stable")]
                for part in np.split(at, range(rows, len(at), rows)):
                    matrix = values[starts[part][:, None] + np.arange(dim)]
                    dims.append(int(dim))
                    payloads.append(pack(ids[part], matrix))
            yield pa.RecordBatch.from_arrays(
                [pa.array(dims, pa.int32()), pa.array(payloads, pa.binary())], ["dim", "payload"])

    return run


def search(vectors: DataFrame, is_query: Column, pack_index: Pack, pack_query: Pack, meet: Meet,
           k: int, kind: str) -> DataFrame:
    """``vectors``: (vec_id, vector), valid rows only. The k best rows of each query, by
    score, ties to the smaller vec_id; rows without a score come last."""
    queries = vectors.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    n, n_queries = vectors.agg(F.count("*"), F.count_if(is_query)).first()
    slots, query_slots = -(-n // INDEX_ROWS) or 1, -(-n_queries // QUERY_ROWS) or 1
    index_rows = vectors.repartition(slots).mapInArrow(packer(pack_index, INDEX_ROWS), "dim int, payload binary")
    query_rows = queries.mapInArrow(packer(pack_query, QUERY_ROWS), "dim int, payload binary")

    def dealt(blocks: DataFrame, own: str, own_slots: int, other: str, other_slots: int, payload: str) -> DataFrame:
        place = F.pmod(F.xxhash64("payload"), F.lit(own_slots)).cast("int").alias(own)
        every = F.explode(F.sequence(F.lit(0), F.lit(other_slots - 1))).alias(other)
        return blocks.select("dim", F.col("payload").alias(payload), place, every).repartition(
            min(MOST_TASKS, slots * query_slots), "dim", "query_slot", "slot")

    pairs = dealt(query_rows, "query_slot", query_slots, "slot", slots, "query").join(
        dealt(index_rows, "slot", slots, "query_slot", query_slots, "index"), ["dim", "query_slot", "slot"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for query, index in zip(batch.column(0), batch.column(1)):
                found = meet(query.as_py(), index.as_py())
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    near = pairs.select("query", "index").mapInArrow(compare, RESULT.format(kind=kind))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
