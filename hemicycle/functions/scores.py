"""Score arithmetic."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from hemicycle.functions.vectors import let
from hemicycle.schemas import CLASSES

# Weight of each class on the -2..+2 scale and on the 0..4 scale.
SCORE_WEIGHTS = (-2, -1, 0, 1, 2)
INDEX_WEIGHTS = (0, 1, 2, 3, 4)


def _weighted(weights: tuple[int, ...], columns: tuple[str, ...]) -> Column:
    return reduce(add, [F.lit(float(w)) * F.col(c) for w, c in zip(weights, columns)])


def sentiment_score(columns: tuple[str, ...] = CLASSES) -> Column:
    return _weighted(SCORE_WEIGHTS, columns)


def sentiment_index_0_4(columns: tuple[str, ...] = CLASSES) -> Column:
    return _weighted(INDEX_WEIGHTS, columns)


def softmax(logits: Column) -> Column:
    """Probabilities from an array of logits (shifted by the maximum)."""
    top = F.array_max(logits).cast("double")
    exps = let(top, lambda m: F.transform(logits, lambda x: F.exp(x.cast("double") - m)))

    def share(e: Column) -> Column:
        total = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
        return let(total, lambda t: F.transform(e, lambda x: x / t))

    return let(exps, share)


def softmax_columns(logits: list[Column]) -> list[Column]:
    """Softmax over separate columns: no arrays, so it stays in generated code."""
    top = F.greatest(*logits)
    exps = [F.exp(x - top) for x in logits]
    total = reduce(add, exps)
    return [e / total for e in exps]


def percent_ratio(part: Column, total: Column) -> Column:
    return F.try_divide(F.lit(100.0) * part, total)


def format_prob(probability: Column) -> Column:
    """Four decimals of a probability, correctly rounded: exact ties go to the even digit.

    Spark's own number formatting rounds the shortest decimal form of the double half up.
    The two differ only next to a tie, so only there the exact binary value is compared.
    """
    scaled = probability * F.lit(1e4)
    low = F.floor(scaled)
    # scaled by a power of two, the double becomes an exact whole number
    tiny = probability < F.lit(2.0**-11)
    factor = F.when(tiny, F.lit(2.0**70)).otherwise(F.lit(2.0**63))
    exact_factor = F.when(tiny, F.lit(Decimal(2**70))).otherwise(F.lit(Decimal(2**63)))
    units = (probability * factor).cast("bigint").cast("decimal(19,0)")
    twice = units * F.lit(Decimal(20_000))
    middle = (low.cast("decimal(5,0)") * F.lit(Decimal(2)) + F.lit(Decimal(1))) * exact_factor
    up = (twice > middle) | ((twice == middle) & (low % 2 == 1))
    exact = F.when(up, low + 1).otherwise(low)
    near_tie = F.abs(scaled - low - F.lit(0.5)) < F.lit(1e-6)
    n = F.when(near_tie, exact).otherwise(F.floor(scaled + F.lit(0.5)))
    text = F.concat(
        F.floor(n / 10_000).cast("string"), F.lit("."), F.lpad((n % 10_000).cast("string"), 4, "0")
    )
    inside = (probability >= 0) & (probability < 1)
    return F.when(inside, text).otherwise(F.format_string("%.4f", probability))
