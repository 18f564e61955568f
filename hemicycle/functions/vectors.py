"""Vector helpers on ARRAY<FLOAT|DOUBLE> columns; sums run in double."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(
        F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def cosine_to(a: Column, query: list[float]) -> Column:
    """Cosine to a fixed vector: one matrix product per Arrow batch.

    Faster on wide vectors than the interpreted element loop of ``cosine``. NULL stays NULL;
    a vector of another length scores 0, like a zero vector.
    """
    q = np.asarray(query, dtype=np.float64)
    q = q / (np.linalg.norm(q) or 1.0)

    @F.arrow_udf("double")
    def score(vectors: pa.Array) -> pa.Array:
        fits = pc.equal(pc.list_value_length(vectors), len(q)).fill_null(False)
        fits = fits.to_numpy(zero_copy_only=False)
        flat = vectors.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False)
        m = flat.astype(np.float64).reshape(-1, len(q))
        norms = np.linalg.norm(m, axis=1)
        out = np.zeros(len(vectors))
        out[fits] = np.divide(m @ q, norms, out=np.zeros(len(m)), where=norms > 0)
        return pa.array(out, mask=vectors.is_null().to_numpy(zero_copy_only=False))

    return score(a)


def drift(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine(a, b)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row.

    Written out directly, a value used inside a lambda is computed again for every element;
    bound as the variable of an outer lambda it is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def l2_normalise(a: Column) -> Column:
    """Unit vector; a zero vector is kept as it is."""
    length = norm(a)
    divisor = F.when(length > 0, length).otherwise(F.lit(1.0))
    return let(divisor, lambda d: F.transform(a, lambda x: x.cast("double") / d))
