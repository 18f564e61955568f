"""Nearest vectors by sign codes: an index that prunes.

The code of a vector is one bit per axis of ``ROTATIONS`` random rotations: the side of the
axis it lies on. It takes a byte per dimension and can be kept beside the vector. A query is
rotated too, and its coordinates, with the signs of a code, estimate the cosine; only the
``share`` of the rows with the best estimates (at least ``least`` rows, and all that are equal
at the edge) are compared by their vectors.

Rows without a vector, with another number of dimensions, or with a null, infinite or zero
vector have no code and are never found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hemicycle.operators.vectors import similarity_to

CODE, ROTATIONS, SEED = "code", 8, 42
SHARE, LEAST = 0.1, 50
#: Vectors that are multiplied at a time.
ROWS_AT_ONCE = 512
#: Rank error of the estimate at the edge, as a part of all rows: 1 / ACCURACY.
ACCURACY = 10_000


def axes(dimension: int, rotations: int = ROTATIONS, seed: int = SEED) -> np.ndarray:
    """(rotations * dimension, dimension): orthonormal axes, rotation after rotation."""
    rng = np.random.default_rng(seed)
    return np.concatenate([np.linalg.qr(rng.normal(size=(dimension, dimension)))[0] for _ in range(rotations)])


def _usable(vectors: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that have a code, and their matrix."""
    sizes = np.array(vectors.value_lengths().fill_null(-1))
    at = np.flatnonzero(sizes == dimension)
    flat = vectors.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    matrix = flat.reshape(len(at), dimension)
    good = np.isfinite(matrix).all(axis=1) & (matrix != 0).any(axis=1)
    return at[good], matrix[good]


def with_codes(df: DataFrame, vector: str, dimension: int, out: str = CODE,
               rotations: int = ROTATIONS, seed: int = SEED) -> DataFrame:
    """Add the code of each vector, as bytes; NULL where there is none."""
    planes = axes(dimension, rotations, seed)

    @F.arrow_udf("binary")
    def code(vectors: pa.Array) -> pa.Array:
        codes: list[bytes | None] = [None] * len(vectors)
        for first in range(0, len(vectors), ROWS_AT_ONCE):
            at, matrix = _usable(vectors.slice(first, ROWS_AT_ONCE), dimension)
            for place, row in zip((at + first).tolist(), np.packbits(matrix @ planes.T > 0, axis=1)):
                codes[place] = row.tobytes()
        return pa.array(codes, pa.binary())

    return df.withColumn(out, code(F.col(vector)))


def estimates(coded: DataFrame, key: str, query: list[float], code: str = CODE,
              rotations: int = ROTATIONS, seed: int = SEED) -> DataFrame:
    """(key, estimate) by codes alone; larger is nearer."""
    asked = np.asarray(query, float)
    weights = (axes(len(asked), rotations, seed) @ asked).astype(np.float32)
    rows = coded.where(F.col(code).isNotNull()).select(key, code)
    schema = T.StructType([coded.schema[key], T.StructField("estimate", T.FloatType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE)):
            packed = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            bits = np.unpackbits(packed, axis=1, count=len(weights))
            # a set bit counts for its coordinate, a clear one against it
            score = 2 * (bits.astype(np.float32) @ weights) - weights.sum()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=[key, "estimate"])

    return rows.mapInArrow(run, schema)


def candidates(coded: DataFrame, key: str, query: list[float], share: float = SHARE,
               least: int = LEAST, code: str = CODE, rotations: int = ROTATIONS, seed: int = SEED) -> DataFrame:
    """Keys of the rows to compare. The edge is a quantile of all estimates, taken by a mergeable
    summary; the codes are read twice, no row is sorted or moved."""
    found = estimates(coded, key, query, code, rotations, seed)
    n = coded.where(F.col(code).isNotNull()).count()
    part = min(1.0, max(share, least / n)) if n else 1.0
    edge = found.agg(F.approx_percentile("estimate", 1.0 - part, ACCURACY)).scalar()
    return found.where(F.col("estimate") >= edge).select(key)


def knn_search_codes(coded: DataFrame, key: str, vector: str, query: list[float], k: int = 10,
                     share: float = SHARE, least: int = LEAST, code: str = CODE,
                     rotations: int = ROTATIONS, seed: int = SEED) -> DataFrame:
    """The k nearest by cosine among the candidates; ``coded`` is made by :func:`with_codes`."""
    chosen = candidates(coded, key, query, share, max(least, k), code, rotations, seed)
    near = coded.where(F.col(code).isNotNull()).join(chosen, key, "left_semi")
    return similarity_to(near, vector, query).drop(vector, code).orderBy(F.desc("score"), key).limit(k)
