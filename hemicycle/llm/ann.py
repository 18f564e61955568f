"""Approximate nearest neighbours by cross-polytope hashing.

A hash is a fast pseudo-rotation (three rounds of random signs and a Hadamard transform)
followed by the nearest signed axis. Every block of rows is an index of its own with
``TABLES`` hash tables over all its rows. A query probes in each table the ``PROBES`` axes
nearest to its own rotated direction, and a row in one of these buckets gets the query's
coordinate along that axis as a vote. The ``SHARE`` of a block's rows with the largest sums
of votes (at least ``LEAST`` of them, and all that are equal at the edge) are the candidates;
they are reranked by the exact inner product of the original vectors.

Nearness is the inner product, so rows get one more coordinate, sqrt(M * M - |x| * |x|), M
being the largest norm of the block, and queries a zero: then the largest inner product is
the smallest angle. For unit vectors this changes nothing.

Recall against brute force on the given tables: see README. Every row is indexed; blocks of
at most ``LEAST`` rows are compared whole, so small tables give whole answers.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite component
take no part; a query meets only vectors of its own length; each repeated row is a candidate
of its own, a repeated query id is asked once (its smallest vector); an empty table, or one
without queries, gives no rows.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemicycle.llm.blocks import finite, search
from hemicycle.llm.common import wanted

TABLES, PROBES, ROUNDS = 32, 64, 3
#: Candidates of a query in a block: this share of its rows, and no fewer than this many.
SHARE, LEAST = 0.05, 512
#: Rows or queries that are rotated at a time.
CHUNK = 256


def butterflies(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each column (length a power of two), orthonormal."""
    n, step = len(x), 1
    while step < n:
        pairs = x.reshape(n // (2 * step), 2, step, -1)
        both = np.empty_like(pairs)
        np.add(pairs[:, 0], pairs[:, 1], out=both[:, 0])
        np.subtract(pairs[:, 0], pairs[:, 1], out=both[:, 1])
        x = both.reshape(n, -1)
        step *= 2
    return x * x.dtype.type(1 / np.sqrt(n))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The transform of each row."""
    return np.ascontiguousarray(butterflies(np.ascontiguousarray(x.T)).T)


def rotated_columns(x: np.ndarray, table: int) -> np.ndarray:
    """Pseudo-rotation of one table, of rows to columns. Twice the next power of two axes, for
    finer buckets."""
    axes = 2 << max(0, (x.shape[1] - 2)).bit_length()
    signs = np.random.default_rng(table)
    out = np.zeros((axes, len(x)), np.float32)
    out[: x.shape[1]] = x.T
    for _ in range(ROUNDS):
        out = butterflies(out * signs.choice(np.array([-1, 1], np.float32), axes)[:, None])
    return out


def rotate(x: np.ndarray, table: int) -> np.ndarray:
    return rotated_columns(x, table).T


def nearest_axis(rotated: np.ndarray) -> np.ndarray:
    """Of each row, the axis and the sign: 2 * axis, plus one if it is negative."""
    axis = np.abs(rotated).argmax(axis=1)
    return 2 * axis + (rotated[np.arange(len(rotated)), axis] < 0)


def lifted(matrix: np.ndarray, largest: float) -> np.ndarray:
    rest = np.maximum(0.0, largest * largest - (matrix * matrix).sum(axis=1))
    return np.concatenate([matrix, np.sqrt(rest)[:, None]], axis=1)


def longest(matrix: np.ndarray) -> float:
    """The largest norm of the rows; components are scaled first, so that no square overflows."""
    scale = float(np.abs(matrix).max())
    return scale * float(np.sqrt(((matrix / scale) ** 2).sum(axis=1).max()))


def build_index(tables: int):
    def pack(ids: np.ndarray, matrix: np.ndarray) -> bytes:
        largest = longest(matrix)
        rows = lifted(matrix / largest, 1.0)
        buckets = np.concatenate([
            np.stack([nearest_axis(rotate(part, t)) for t in range(tables)]).astype(np.uint32)
            for part in np.split(rows, range(CHUNK, len(rows), CHUNK))], axis=1)
        return pickle.dumps((ids.astype(np.int64), matrix, buckets))

    return pack


def unit(queries: np.ndarray) -> np.ndarray:
    """Queries of length one: their length changes no order."""
    largest = np.abs(queries).max(axis=1, keepdims=True)
    scaled = queries / largest
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def pack_queries(ids: np.ndarray, matrix: np.ndarray) -> bytes:
    return pickle.dumps((ids.astype(np.int64), matrix))


def votes(queries: np.ndarray, buckets: np.ndarray, probes: int) -> np.ndarray:
    """(queries, rows): sums, over the tables, of the query's coordinates at probed axes."""
    asked = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1)
    total = np.zeros((buckets.shape[1], len(queries)), np.float32)
    for table, bucket in enumerate(buckets):
        rotated = rotated_columns(asked, table)
        near = np.stack([rotated, -rotated], axis=1).reshape(-1, len(asked))
        if probes < len(near):
            near *= near >= np.partition(near, -probes, axis=0)[-probes]
        total += near[bucket]
    return np.ascontiguousarray(total.T)


def candidates(total: np.ndarray, size: int) -> np.ndarray:
    """Boolean (queries, rows): the ``size`` rows with the most votes, and those equal to the last."""
    if size >= total.shape[1]:
        return np.ones(total.shape, bool)
    return total >= np.partition(total, -size, axis=1)[:, -size, None]


def exact_scores(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products summed in order of dimension, so equal rows have equal scores."""
    total = np.zeros(len(rows))
    for d in range(len(query)):
        total += rows[:, d] * query[d]
    return total


def meet_near(k: int, probes: int, share: float, least: int):
    def meet(query_block: bytes, index_block: bytes):
        query_ids, queries = pickle.loads(query_block)
        ids, matrix, buckets = pickle.loads(index_block)
        # one more than asked for: a query is never its own candidate
        size = max(least, k, int(np.ceil(share * len(ids)))) + 1
        found = np.concatenate([candidates(votes(part, buckets, probes), size)
                                for part in np.split(unit(queries), range(CHUNK, len(queries), CHUNK))])
        norm = longest(matrix)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i, query_id in enumerate(query_ids.tolist()):
            rows = np.flatnonzero(found[i] & (ids != query_id))
            if len(rows) > k:
                rough = matrix[rows] @ queries[i]
                edge = np.partition(rough, -k)[-k]
                slack = 1e-12 * norm * float(np.sqrt((queries[i] * queries[i]).sum()))
                rows = rows[~(rough < edge - slack)]
            score = exact_scores(queries[i], matrix[rows])
            best = np.lexsort((ids[rows], -score))[:k]
            out.append((np.full(len(best), query_id), ids[rows[best]], score[best]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*out))

    return meet


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, tables: int = TABLES, probes: int = PROBES,
            share: float = SHARE, least: int = LEAST, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Each query (id divisible by ``every``) with the k nearest other rows it finds."""
    rows = wanted(vectors, vec_id=id_column, vector=vector_column).where(
        F.col("vec_id").isNotNull() & finite(F.col("vector")) & F.exists("vector", lambda x: x != 0))
    return search(rows, F.col("vec_id") % every == 0, build_index(tables), pack_queries,
                  meet_near(k, probes, share, least), k, "double")
