"""Exact top-k search by inner product on a bit-sliced index.

Every component becomes floor(1024 * x). A block of rows keeps, per dimension and bit, one
bitmap over its rows (a slice). For a query, the products are sums of shifted slices: each
set bit i of a query component adds that dimension's slices at weights i, i + 1, ...
(negative components add complements), and all bitmaps of one weight are reduced by
carry-save addition, with bitmap arithmetic only. The result is a bit-sliced score. The k
best rows are selected from the most significant slice downward: rows sure to be in, and
rows still tied. When the slices end, the boundary rows are exact ties, and the smallest ids
among them fill the remaining places.

Defined cases: vectors that are null, empty, or hold a null or non-finite component take no
part; numbers of any size do (slices are as many as the block's range needs), and the job
fails if a score that is to be returned is no long; a query meets only vectors of its own length; each repeated row is a candidate of its
own, a repeated query id is asked once (its smallest vector); an empty table, or one without
queries, gives no rows.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemicycle.llm.blocks import finite, search
from hemicycle.llm.common import wanted

SCALE, NARROW = 1024, float(1 << 18)
LONG = 1 << 63
#: Bits of a query component that are added at a time.
GROUP = 32


def quantise(matrix: np.ndarray) -> np.ndarray:
    """floor(1024 * x), as int64; as Python integers where a component is large."""
    if np.abs(matrix).max(initial=0.0) < NARROW:
        return np.floor(matrix * SCALE).astype(np.int64)
    # times 1024 is exact: a double of 2**53 or more is an integer
    exact = [int(x) * SCALE if abs(x) >= 2.0**53 else math.floor(x * SCALE) for x in matrix.ravel().tolist()]
    return np.array(exact, object).reshape(matrix.shape)


def to_bitmaps(bits: np.ndarray) -> np.ndarray:
    """(..., rows) of 0 and 1 to (..., words) of 64 rows each."""
    rows = bits.shape[-1]
    padded = np.zeros((*bits.shape[:-1], -(-rows // 64) * 64), np.uint8)
    padded[..., :rows] = bits
    return np.packbits(padded, axis=-1, bitorder="little").view(np.uint64)


def build_slices(ids: np.ndarray, matrix: np.ndarray) -> bytes:
    """Payload of an index block: its rows in order of id, one bitmap per dimension and bit."""
    values = quantise(matrix)
    low = int(values.min())
    above = (values - low).T
    width = max(1, int(above.max()).bit_length())
    slices = np.stack([to_bitmaps(((above >> j) & 1).astype(np.uint8)) for j in range(width)], axis=1)
    return pickle.dumps((ids.astype(np.int64), low, slices))


def pack_queries(ids: np.ndarray, matrix: np.ndarray) -> bytes:
    return pickle.dumps((ids.astype(np.int64), quantise(matrix)))


def add_slices(query: np.ndarray, slices: np.ndarray) -> list[np.ndarray]:
    """Bit-sliced sum of |q| * u, u complemented where q is negative; lowest slice first.

    The bits of q are taken in groups, the highest first, so memory stays that of one group
    however large its numbers are.
    """
    chosen = np.where((query < 0)[:, None, None], ~slices, slices)
    size, width = np.abs(query), slices.shape[1]
    total: list[np.ndarray] = []
    for first in reversed(range(0, max(1, int(size.max()).bit_length()), GROUP)):
        piles = {weight + GROUP: [bits[None]] for weight, bits in enumerate(total)}
        for i in range(GROUP):
            rows = chosen[((size >> (first + i)) & 1).astype(bool)]
            if len(rows):
                for j in range(width):
                    piles.setdefault(i + j, []).append(rows[:, j])
        total = reduced(piles, slices.shape[2])
    return total


def reduced(piles: dict[int, list[np.ndarray]], words: int) -> list[np.ndarray]:
    """One slice per weight: the bitmaps of a weight are added by carry-save, carries go up."""
    result, weight = [], 0
    while piles:
        pile = np.concatenate(piles.pop(weight, [np.zeros((1, words), np.uint64)]))
        carries = []
        while len(pile) > 1:
            third = len(pile) // 3
            if third:
                a, b, c = pile[:third], pile[third:2 * third], pile[2 * third:3 * third]
                half = a ^ b
                carries.append((a & b) | (half & c))
                pile = np.concatenate([half ^ c, pile[3 * third:]])
            else:
                carries.append(pile[:1] & pile[1:2])
                pile = pile[:1] ^ pile[1:2]
        if carries:
            piles.setdefault(weight + 1, []).extend(carries)
        result.append(pile[0])
        weight += 1
    return result


def count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def rows_of(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def select_top(slices: list[np.ndarray], among: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k largest values, ties to the lower row, from the top slice downward."""
    sure, tied = np.zeros_like(among), among
    if count(among) > k:
        for bits in reversed(slices):
            inside = sure | (tied & bits)
            n = count(inside)
            if n > k:
                tied = tied & bits
            else:
                sure, tied = inside, tied & ~bits
                if n == k:
                    tied = np.zeros_like(tied)
                    break
        boundary = rows_of(tied)[: k - count(sure)]
        return np.concatenate([rows_of(sure), boundary])
    return rows_of(among)


def scores_of(slices: list[np.ndarray], rows: np.ndarray, moved: int) -> list[int | None]:
    """Scores of some rows, read off the slices; None for one below every long."""
    held = [((bits[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).tolist() for bits in slices]
    found: list[int | None] = []
    for i in range(len(rows)):
        score = moved + sum(bits[i] << weight for weight, bits in enumerate(held))
        if score >= LONG:
            raise OverflowError("a score among the best is larger than any long")
        found.append(score if score >= -LONG else None)
    return found


def meet_top(k: int):
    """Function of a query block and an index block: the k best rows of each query."""

    def meet(query_block: bytes, index_block: bytes):
        query_ids, queries = pickle.loads(query_block)
        ids, low, slices = pickle.loads(index_block)
        top_value = (1 << slices.shape[1]) - 1
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for query_id, query in zip(query_ids.tolist(), queries):
            among = to_bitmaps((ids != query_id).astype(np.uint8))
            total = add_slices(query, slices)
            rows = select_top(total, among, k)
            moved = low * int(query.sum()) + top_value * int(query[query < 0].sum())
            found.append((np.full(len(rows), query_id), ids[rows], scores_of(total, rows, moved)))
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        asked, near, scores = zip(*found)
        return (np.concatenate(asked).astype(np.int64), np.concatenate(near).astype(np.int64),
                pa.array([x for part in scores for x in part], pa.int64()))

    return meet


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, id_column: str = "vec_id",
          vector_column: str = "embedding") -> DataFrame:
    """Each query (id divisible by ``every``) with its k best other rows."""
    rows = wanted(vectors, vec_id=id_column, vector=vector_column).where(
        F.col("vec_id").isNotNull() & finite(F.col("vector")))
    found = search(rows, F.col("vec_id") % every == 0, build_slices, pack_queries, meet_top(k), k, "long")
    return found.withColumn("score", F.coalesce("score", F.raise_error(F.lit("a score among the best is below every long"))))


SQL = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM good q JOIN good c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
         vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 10
"""
