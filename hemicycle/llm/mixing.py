"""Temperature mixing of sources, realised as budgeted block permutations.

The share p of a source is its part of all tokens (words); its weight is p ** a, normalised.
The exponent a is bisected on a grid of 1/65536 to meet either target:

* ``repetition_limit``: the smallest a (flattest mix) at which no source is repeated more
  than that many times;
* ``entropy``: the largest a (least change) at which the weights have at least that entropy
  in nats.

``budget`` is the number of tokens drawn in all. Without it, the budget is the least at
which no source is cut, so that every document is drawn at least once. A source's tokens
are drawn as whole passes over it, each in a permutation of its own (order of
md5(doc_id ':' epoch)), and one last pass that stops before its budget would be passed.

The last pass needs running sums over a source, and one source may hold a third of all
rows: sums are taken per block (the first four digits of the permutation key) by partial
aggregation, blocks are accumulated, and only the block in which the budget ends is
accumulated key by key, rows of one key being added up before. No task ever sees a whole source.

Defined cases: a null source is a source of its own; a null text has no tokens; documents
of a source without tokens are drawn once; rows that share a doc_id (null included) have
the same key and are drawn together; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hemicycle.llm.common import BROADCAST_ROWS, cut, n_words, wanted

GRID = 1 << 16
#: Halvings of the interval per pass over the table of sources.
HALVINGS = 4
REPETITION_LIMIT = 2.0


def slot(doc_id: Column, epoch: Column) -> Column:
    """Place of a document in the permutation of one epoch."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), epoch.cast("string")))


def entropy_of(z: float, zlog: float) -> float:
    """Entropy of weights x / z, given the sums of x and of x log x."""
    return math.log(z) - zlog / z


def find_exponent(sources: DataFrame, repetition_limit: float | None, entropy: float | None,
                  budget: int | None) -> float:
    """Bisect on the grid; each pass tries the 15 points of four halvings at once.

    ``sources`` has tokens per source. Only these few numbers reach the driver.
    """
    shares = sources.where("tokens > 0").agg(F.sum("tokens").alias("all"), F.max("tokens").alias("most")).first()
    if not shares or not shares["all"]:
        return 1.0
    share = F.col("tokens") / F.lit(float(shares["all"]))
    low, high = 0, GRID  # the answer lies in low..high
    while low < high:
        step = max(1, (high - low) >> HALVINGS)
        points = list(range(low, high, step)) + [high]
        power = F.pow(share, F.col("a"))
        at = F.explode(F.array(*[F.lit(p) for p in points])).alias("point")
        tried = (
            sources.where("tokens > 0").select("tokens", at)
            .withColumn("a", F.col("point") / F.lit(float(GRID)))
            .groupBy("point")
            .agg(
                F.sum(power).alias("z"),
                F.sum(power * F.col("a") * F.log(share)).alias("zlog"),
                F.max(F.pow(F.lit(float(shares["most"])) / F.col("tokens"), 1 - F.col("a"))).alias("repeats"),
                F.max(F.pow(share, F.col("a") - 1)).alias("lift"),
            )
            .collect()
        )
        if repetition_limit is not None:
            most = {
                r["point"]: r["repeats"] if budget is None else budget / shares["all"] * r["lift"] / r["z"]
                for r in tried
            }
            good = [p for p in points if most[p] <= repetition_limit] or [high]
            new_high = min(good)
            new_low = max([p + 1 for p in points if p < new_high], default=low)
            low, high = min(new_low, new_high), new_high
        else:
            held = {r["point"]: entropy_of(r["z"], r["zlog"]) >= entropy for r in tried}
            new_low = max([p for p in points if held[p]], default=low)
            new_high = min([p - 1 for p in points if p > new_low], default=high)
            low, high = new_low, max(new_low, new_high)
    return low / GRID


def plan_mix(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    repetition_limit: float | None = REPETITION_LIMIT,
    entropy: float | None = None,
    budget: int | None = None,
) -> DataFrame:
    """One row per source: tokens, exponent, weight, budget, whole passes, and the key up
    to which the last, partial pass goes."""
    if (repetition_limit is None) == (entropy is None):
        raise ValueError("give either repetition_limit or entropy")
    counted = cut(
        wanted(documents, doc_id=id_column, source=source_column, text=text_column)
        .select("doc_id", "source", n_words("text").cast("long").alias("tokens"))
    )
    sources = cut(counted.groupBy("source").agg(F.sum("tokens").alias("tokens")))
    exponent = find_exponent(sources, repetition_limit, entropy, budget)
    sums = sources.where("tokens > 0").agg(
        F.sum("tokens").alias("all"), F.max("tokens").alias("most")).first()
    every, most = float(sums["all"] or 1), float(sums["most"] or 1)
    power = F.pow(F.col("tokens") / F.lit(every), F.lit(exponent))
    z = sources.where("tokens > 0").agg(F.sum(power)).first()[0] or 1.0
    if budget is None:
        drawn = F.col("tokens") * F.pow(F.lit(most) / F.col("tokens"), F.lit(1.0 - exponent))
    else:
        drawn = F.lit(float(budget)) * power / F.lit(z)
    planned = sources.select(
        "source", "tokens",
        F.lit(exponent).alias("exponent"),
        F.when(F.col("tokens") > 0, power / F.lit(z)).otherwise(0.0).alias("weight"),
        F.when(F.col("tokens") > 0, F.floor(drawn + 0.5).cast("long")).otherwise(0).alias("budget"),
    ).select(
        "*",
        F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(1).cast("int").alias("passes"),
        F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(0).alias("rest"),
    )
    planned = cut(planned)
    return cut(with_cutoff(counted, planned))


def with_cutoff(counted: DataFrame, planned: DataFrame) -> DataFrame:
    """Add ``cutoff``: the last key of the partial pass that its budget still covers."""
    partial = planned.where("rest > 0").select("source", "passes", "rest")
    keyed = match_source(counted, partial).select(
        "source", "rest", "tokens", slot(F.col("doc_id"), F.col("passes")).alias("slot")
    ).withColumn("block", F.substring("slot", 1, 4))
    before = Window.partitionBy("source").orderBy("block")
    blocks = (
        keyed.groupBy("source", "rest", "block").agg(F.sum("tokens").alias("tokens"))
        .withColumn("upto", F.sum("tokens").over(before))
        .where(F.col("upto") > F.col("rest"))
        .groupBy("source")
        .agg(F.min(F.struct("block", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("left"))).alias("end"))
        .select("source", "end.block", "end.left")
    )
    ends = cut(blocks)
    last = summed_slots(keyed, ends).groupBy("source").agg(
        F.max(F.when(F.col("upto") <= F.col("left"), F.col("slot"))).alias("last"))
    cutoffs = match_source(ends, last).select("source", F.coalesce("last", "block").alias("cutoff"))
    return match_source(planned, cutoffs, "left").withColumn("cutoff", F.coalesce("cutoff", F.lit("")))


def summed_slots(keyed: DataFrame, ends: DataFrame) -> DataFrame:
    """(source, left, slot, tokens, upto) of the blocks in which budgets end: running sums, one row
    per slot, as rows of one doc_id (null included) share a slot however many they are."""
    inside = Window.partitionBy("source").orderBy("slot")
    return (
        match_source(keyed.drop("rest"), ends.withColumnRenamed("block", "end_block"))
        .where(F.col("block") == F.col("end_block"))
        .groupBy("source", "left", "slot").agg(F.sum("tokens").alias("tokens"))
        .withColumn("upto", F.sum("tokens").over(inside))
    )


def match_source(rows: DataFrame, per_source: DataFrame, how: str = "inner") -> DataFrame:
    """Join one row per source, null being a source. Broadcast only if counted small."""
    side = per_source.withColumnRenamed("source", "_source")
    if side.count() <= BROADCAST_ROWS:
        side = F.broadcast(side)
    return rows.join(side, rows["source"].eqNullSafe(side["_source"]), how).drop("_source")


def draw(documents: DataFrame, plan: DataFrame, id_column: str = "doc_id",
         source_column: str = "source", epoch: str = "epoch") -> DataFrame:
    """Repeat each document once per pass that draws it; its columns are kept."""
    side = plan.select(F.col("source").alias("__source"), F.col("passes").alias("__passes"),
                       F.col("cutoff").alias("__cutoff"))
    if side.count() <= BROADCAST_ROWS:
        side = F.broadcast(side)
    taken = F.col("__passes") + (slot(documents[id_column], F.col("__passes")) <= F.col("__cutoff")).cast("int")
    return (
        documents.join(side, documents[source_column].eqNullSafe(side["__source"]))
        .withColumn("__taken", taken)
        .where("__taken > 0")
        .withColumn(epoch, F.explode(F.sequence(F.lit(0), F.col("__taken") - 1)))
        .drop("__source", "__passes", "__cutoff", "__taken")
    )


def mix(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text",
        source_column: str = "source", **target) -> DataFrame:
    """Every draw: doc_id, source, tokens, epoch and the place (slot) in its permutation.

    Training order is by epoch, then slot.
    """
    plan = plan_mix(documents, id_column, text_column, source_column, **target)
    rows = wanted(documents, doc_id=id_column, source=source_column, text=text_column).select(
        "doc_id", "source", n_words("text").cast("long").alias("tokens"))
    return draw(rows, plan).select(
        "doc_id", "source", "tokens", "epoch", slot(F.col("doc_id"), F.col("epoch")).alias("slot"))


SQL = f"""
WITH counted AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens
  FROM documents),
sources AS (SELECT source, sum(tokens)::BIGINT AS tokens FROM counted GROUP BY source),
tried AS (
  SELECT g, max(pow((SELECT max(tokens) FROM sources)::DOUBLE / tokens, 1 - g / {float(GRID)})) AS repeats
  FROM sources, range(0, {GRID + 1}) AS r(g) WHERE tokens > 0 GROUP BY g),
best AS (SELECT min(g) / {float(GRID)} AS a FROM tried WHERE repeats <= {REPETITION_LIMIT}),
budgets AS (
  SELECT source, tokens, CASE WHEN tokens > 0 THEN floor(
    tokens * pow((SELECT max(tokens) FROM sources)::DOUBLE / tokens, 1 - (SELECT a FROM best)) + 0.5)::BIGINT
    ELSE 0 END AS budget FROM sources),
plan AS (
  SELECT source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS passes,
         CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM budgets),
keyed AS (
  SELECT c.*, p.passes, p.rest, md5(concat(coalesce(c.doc_id::VARCHAR, ''), ':', p.passes::VARCHAR)) AS slot
  FROM counted c JOIN plan p ON c.source IS NOT DISTINCT FROM p.source),
summed AS (
  SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY slot
                              RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM keyed),
taken AS (
  SELECT *, passes + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS n FROM summed)
SELECT doc_id, source, tokens, epoch::INTEGER AS epoch,
       md5(concat(coalesce(doc_id::VARCHAR, ''), ':', epoch::VARCHAR)) AS slot
FROM (SELECT *, unnest(range(0, n)) AS epoch FROM taken)
"""
