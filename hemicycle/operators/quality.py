"""Duplicates, reconciliation and data-quality checks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from hemicycle.functions import text as tx
from hemicycle.operators import ordering
from hemicycle.schemas import REQUIRED_FIELDS

N = "n"


# duplicates: the key is a digest, so long texts are not shuffled


def key_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(tx.digest(*[F.col(k) for k in keys]).alias("key_digest")).agg(
        F.count("*").alias(N)
    )


def duplicates_by_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Duplicated keys with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias(N)).where(F.col(N) > 1)


def duplicates_by_long_key(df: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """The same for keys such as whole texts: the first row of each duplicated key with the
    count. Only digests are shuffled, never the keys."""
    digest = tx.digest(*[F.col(k) for k in keys]).alias("_d")
    return (
        df.select(digest, row_id).groupBy("_d")
        .agg(F.min(row_id).alias(row_id), F.count("*").alias(N))
        .where(F.col(N) > 1).drop("_d")
    )


def duplicate_totals(df: DataFrame, keys: list[str]) -> DataFrame:
    dup = F.col(N) > 1
    return key_counts(df, keys).agg(
        F.coalesce(F.sum(N), F.lit(0)).alias("entries"),
        F.count("*").alias("unique_keys"),
        F.count_if(dup).alias("duplicated_keys"),
        F.coalesce(F.sum(F.when(dup, F.col(N))), F.lit(0)).alias("entries_in_duplicates"),
    )


def duplicates_kind(df: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """Duplicated keys whose entries are all identical, and those that differ."""
    key = tx.digest(*[F.col(k) for k in keys]).alias("_d")
    content = tx.digest(*[F.col(c) for c in compare]).alias("_c")
    groups = df.select(key, content).groupBy("_d").agg(
        F.count("*").alias(N), (F.min("_c") == F.max("_c")).alias("same")
    ).where(F.col(N) > 1)
    return groups.agg(
        F.count_if(F.col("same")).alias("identical"), F.count_if(~F.col("same")).alias("different")
    )


def duplicate_diff_fields(
    df: DataFrame, keys: list[str], order: str, compare: list[str], chunk: Column | None = None
) -> DataFrame:
    """For each repeated entry the fields that differ from the previous one of its key."""
    digested = df.select(
        tx.digest(*[F.col(k) for k in keys]).alias("_d"), order, *compare
    )
    lagged = ordering.lag_in_key(
        digested, ["_d"], [order], compare, chunk if chunk is not None else ordering.ordinal_chunk(order)
    ).where("has_prev")
    differing = F.concat_ws(", ", *[
        F.when(~F.col(c).eqNullSafe(F.col(f"prev_{c}")), F.lit(c)) for c in compare
    ])
    return lagged.select(order, differing.alias("differences"), (differing == "").alias("identical"))


def top_duplicates(df: DataFrame, keys: list[str], row_id: str, n: int = 20) -> DataFrame:
    """The largest groups, ties by first appearance. Keys are looked up for the n groups only:
    a limited side is known to be small, so the table is not shuffled for it."""
    top = duplicates_by_long_key(df, keys, row_id).orderBy(F.desc(N), row_id).limit(n)
    return top.join(df.select(row_id, *keys), row_id).select(row_id, *keys, N)


def duplicate_entries(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of duplicated keys with the size of their group, one row each.

    Groups are matched by digest; a group is never gathered into one cell.
    """
    marked = df.withColumn("_d", tx.digest(*[F.col(k) for k in keys]))
    groups = key_counts(df, keys).where(F.col(N) > 1).withColumnRenamed("key_digest", "_d")
    return marked.join(groups, "_d").withColumnRenamed(N, "group_size").drop("_d")


# reconciliation


def side_counts(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """(id, n_left, n_right): one row per id of either side."""
    def side(df: DataFrame, l: int, r: int) -> DataFrame:
        return df.select(column, F.lit(l).alias("l"), F.lit(r).alias("r"))

    # one aggregation of both sides instead of two and a full join
    return side(left, 1, 0).unionByName(side(right, 0, 1)).groupBy(column).agg(
        F.sum("l").alias("n_left"), F.sum("r").alias("n_right")
    )


def reconcile_ids(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Totals, uniques, common, missing, extra, duplicates per side, match rate."""
    l, r = F.col("n_left"), F.col("n_right")
    zero = F.lit(0)
    return side_counts(left, right, column).agg(
        F.coalesce(F.sum(l), zero).alias("total_left"),
        F.coalesce(F.sum(r), zero).alias("total_right"),
        F.count_if(l > 0).alias("unique_left"),
        F.count_if(r > 0).alias("unique_right"),
        F.count_if((l > 0) & (r > 0)).alias("common"),
        F.count_if((l > 0) & (r == 0)).alias("missing"),
        F.count_if((l == 0) & (r > 0)).alias("extra"),
        F.count_if(l > 1).alias("duplicates_left"),
        F.count_if(r > 1).alias("duplicates_right"),
    ).withColumn(
        "match_rate",
        F.coalesce(F.try_divide(F.lit(100.0) * F.col("common"), F.col("unique_left")), F.lit(0.0)),
    )


def reconcile_detail(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """One row per finding: missing, extra, duplicate_left, duplicate_right with its count."""
    l, r = F.col("n_left"), F.col("n_right")
    findings = F.array_compact(F.array(
        F.when(r == 0, F.struct(F.lit("missing").alias("finding"), l.alias(N))),
        F.when(l == 0, F.struct(F.lit("extra").alias("finding"), r.alias(N))),
        F.when(l > 1, F.struct(F.lit("duplicate_left").alias("finding"), l.alias(N))),
        F.when(r > 1, F.struct(F.lit("duplicate_right").alias("finding"), r.alias(N))),
    ))
    return side_counts(left, right, column).select(column, F.inline(findings))


# checks: one row (check, value, threshold, passed) each


def _check(df: DataFrame, name: str, value: Column, threshold: Column, passed: Column) -> DataFrame:
    return df.select(
        F.lit(name).alias("check"),
        value.cast("double").alias("value"),
        threshold.cast("double").alias("threshold"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
    )


def _at_most(df: DataFrame, name: str, counted: Column, limit: float = 0) -> DataFrame:
    one = df.agg(counted.alias("v"))
    return _check(one, name, F.col("v"), F.lit(limit), F.col("v") <= limit)


def _at_least(df: DataFrame, name: str, counted: Column, limit: float) -> DataFrame:
    one = df.agg(counted.alias("v"))
    return _check(one, name, F.col("v"), F.lit(limit), F.col("v") >= limit)


def _lacking(df: DataFrame, required: tuple[str, ...]) -> Column:
    """How many required fields are no column, or NULL in every row."""
    lacking = [(F.count(F.col(c)) == 0).cast("int") if c in df.columns else F.lit(1) for c in required]
    return reduce(lambda a, b: a + b, lacking, F.lit(0))


def dq_required_fields(df: DataFrame, required: tuple[str, ...] = REQUIRED_FIELDS) -> DataFrame:
    return _at_most(df, "required_fields", _lacking(df, required))


def dq_core_fields(df: DataFrame, columns: list[str]) -> DataFrame:
    absent = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
    return _at_most(df, "core_fields", F.count_if(absent))


def dq_no_empty_text(df: DataFrame, text: str) -> DataFrame:
    return _at_most(df, "no_empty_text", F.count_if(tx.is_blank(F.col(text))))


def dq_dates_valid(df: DataFrame, date_text: str) -> DataFrame:
    bad = F.col(date_text).isNotNull() & F.try_to_date(F.col(date_text), "yyyy-MM-dd").isNull()
    return _at_most(df, "dates_valid", F.count_if(bad))


def dq_names_nonempty(df: DataFrame, name: str) -> DataFrame:
    return _at_most(df, "names_nonempty", F.count_if(F.col(name) == ""))


def dq_short_texts(df: DataFrame, text: str, shorter_than: int = 10, share: float = 0.05) -> DataFrame:
    one = df.agg(
        F.count_if(F.length(text) < shorter_than).alias("v"), F.count("*").alias("n")
    ).withColumn("t", F.floor(F.lit(share) * F.col("n")))
    return _check(one, "short_texts", F.col("v"), F.col("t"), F.col("v") <= F.col("t"))


def dq_min_rows(df: DataFrame, least: int = 100) -> DataFrame:
    return _at_least(df, "min_rows", F.count("*"), least)


def dq_min_speakers(df: DataFrame, speaker: str, least: int = 10) -> DataFrame:
    return _at_least(df, "min_speakers", F.count_distinct(F.col(speaker)), least)


def dq_avg_length(df: DataFrame, text: str, low: float = 50, high: float = 5000) -> DataFrame:
    one = df.agg(F.avg(tx.text_length(F.col(text))).alias("v"))
    return _check(one, "avg_length", F.col("v"), F.lit(high), F.col("v").between(low, high))


def dq_count_tolerance(raw: DataFrame, loaded: DataFrame, share: float = 0.05) -> DataFrame:
    """|loaded - raw| within max(1, share of raw)."""
    loaded_n = loaded.agg(F.count("*")).scalar()
    one = raw.agg(F.count("*").alias("a")).withColumn("b", loaded_n).select(
        F.abs(F.col("a") - F.col("b")).alias("v"),
        F.greatest(F.lit(1), F.floor(F.lit(share) * F.col("a"))).alias("t"),
    )
    return _check(one, "count_tolerance", F.col("v"), F.col("t"), F.col("v") <= F.col("t"))


def dq_ids_exist(expected: DataFrame, table: DataFrame, column: str, name: str = "ids_exist") -> DataFrame:
    """Expected ids (or metadata values) that the table lacks."""
    wanted = expected.select(column).where(F.col(column).isNotNull()).distinct()
    lacking = wanted.join(table.select(column), column, "left_anti")
    return _at_most(lacking, name, F.count("*"))


def dq_metadata_exist(expected: DataFrame, table: DataFrame, column: str) -> DataFrame:
    return dq_ids_exist(expected, table, column, "metadata_exist")


def dq_text_equal(a: DataFrame, b: DataFrame, key: str, text: str) -> DataFrame:
    """Texts of common keys that differ after blanks are collapsed."""
    def side(df: DataFrame, name: str) -> DataFrame:
        # only a digest of the cleaned text travels to the join
        return df.select(key, F.sha2(tx.clean_text(F.col(text)), 256).alias(name))

    joined = side(a, "da").join(side(b, "db"), key)
    return _at_most(joined, "text_equal", F.count_if(F.col("da") != F.col("db")))


Score = Callable[[DataFrame, str], DataFrame]


def dq_score_order(
    pairs: DataFrame, score: Score, low: str = "low", high: str = "high", least: float = 0.75,
) -> DataFrame:
    """Share of (low, high) text pairs whose scores are in order. ``score(df, text)`` adds a
    ``score`` column; both texts of a pair stay in one row, so nothing is joined."""
    scored = score(score(pairs, low).withColumnRenamed("score", "s_low"), high)
    share = F.try_divide(F.count_if(F.col("s_low") < F.col("score")), F.count("*"))
    return _at_least(scored, "score_order", share, least)


def dq_score_references(
    phrases: DataFrame, score: Score, label: str = "label", text: str = "text",
    neutral: tuple[float, float] = (1.0, 3.0),
) -> DataFrame:
    """Reference phrases by class: the extreme classes' mean scores are in order, and that of the
    neutral class lies in its range. One pass over the phrases."""
    def mean(kind: str) -> Column:
        return F.avg(F.when(F.col(label) == kind, F.col("score")))

    means = score(phrases, text).agg(
        mean("very_negative").alias("low"), mean("very_positive").alias("high"), mean("neutral").alias("mid"))
    apart = F.col("high") - F.col("low")
    return _check(means, "score_extremes", apart, F.lit(0), apart > 0).unionByName(
        _check(means, "score_neutral", F.col("mid"), F.lit(neutral[1]), F.col("mid").between(*neutral)))


def dq_score_sums(df: DataFrame, classes: tuple[str, ...], tolerance: float = 1e-5) -> DataFrame:
    """The largest distance of a row's class probabilities from a sum of one."""
    total = reduce(lambda a, b: a + b, [F.col(c) for c in classes])
    return _at_most(df, "score_sums", F.max(F.abs(total - 1)), tolerance)


def quality_report(*checks: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), checks)


# many checks at once


@dataclass(frozen=True)
class Checked:
    """Columns of a table that the checks look at."""

    key: str
    text: str
    date_text: str
    speaker: str
    metadata: str
    core: tuple[str, ...]
    required: tuple[str, ...]


def _counted(df: DataFrame, c: Checked) -> dict[str, Column]:
    """What one row adds to each sum that the checks over rows need."""
    absent = reduce(lambda a, b: a | b, [F.col(x).isNull() for x in c.core])
    bad_date = F.col(c.date_text).isNotNull() & F.try_to_date(F.col(c.date_text), "yyyy-MM-dd").isNull()
    length = tx.text_length(F.col(c.text))
    flags = {
        "core_fields": absent, "no_empty_text": tx.is_blank(F.col(c.text)), "dates_valid": bad_date,
        "names_nonempty": F.col(c.speaker) == "", "short_texts": length < 10, "with_text": F.col(c.text).isNotNull(),
        **{f"has_{x}": F.col(x).isNotNull() for x in c.required if x in df.columns},
    }
    ones = {n: F.when(flag, 1).otherwise(0).cast("long") for n, flag in flags.items()}
    return {"rows": F.lit(1).cast("long"), "characters": F.coalesce(length, F.lit(0)).cast("long"), **ones}


def _row_checks(names: list[str], c: Checked) -> list[tuple[str, Column, Column, Column]]:
    """(name, value, threshold, passed) of the checks over rows, from the columns of their sums."""
    lacking = [(F.col(f"has_{x}") == 0).cast("int") if f"has_{x}" in names else F.lit(1) for x in c.required]
    lacking = reduce(lambda a, b: a + b, lacking, F.lit(0))
    few, mean = F.floor(F.lit(0.05) * F.col("rows")), F.try_divide(F.col("characters"), F.col("with_text"))
    none = [("required_fields", lacking), *[(n, F.col(n)) for n in (
        "core_fields", "no_empty_text", "dates_valid", "names_nonempty")]]
    return [
        *[(n, v, F.lit(0), v <= 0) for n, v in none],
        ("short_texts", F.col("short_texts"), few, F.col("short_texts") <= few),
        ("min_rows", F.col("rows"), F.lit(100), F.col("rows") >= 100),
        ("min_speakers", F.col("speakers"), F.lit(10), F.col("speakers") >= 10),
        ("avg_length", mean, F.lit(5000), mean.between(50, 5000)),
    ]


def _as_report(one: DataFrame, checks: list[tuple[str, Column, Column, Column]]) -> DataFrame:
    return one.select(F.inline(F.array(*[F.struct(
        F.lit(n).alias("check"), v.cast("double").alias("value"), t.cast("double").alias("threshold"),
        F.coalesce(p, F.lit(False)).alias("passed")) for n, v, t, p in checks])))


class Watch:
    """The nine checks over rows, taken while the rows are written.

    ``watch.over(df)`` is the last step before a write: its sums are then made in the tasks that
    write, each of which counts once however often it is run. ``report()`` waits for the write;
    no row is read again. Speakers are counted approximately.
    """

    def __init__(self, c: Checked):
        self.checked, self.observation = c, Observation()

    def over(self, df: DataFrame) -> DataFrame:
        self.spark = df.sparkSession
        sums = [F.sum(v).alias(n) for n, v in _counted(df, self.checked).items()]
        speakers = F.approx_count_distinct(F.col(self.checked.speaker), 0.01).alias("speakers")
        return df.observe(self.observation, *sums, speakers)

    def report(self) -> DataFrame:
        found = {n: v or 0 for n, v in self.observation.get.items()}
        one = self.spark.createDataFrame([tuple(found.values())], ", ".join(f"`{n}` long" for n in found))
        return _as_report(one, _row_checks(list(found), self.checked))


def full_report(table: DataFrame, expected: DataFrame, c: Checked) -> DataFrame:
    """All thirteen checks of a loaded table against what was extracted, reading each side once.

    A row of either side becomes up to three short records (its key with a digest of its text,
    its metadata value, its speaker); one shuffle groups them, and the groups are counted. What
    the checks over rows need is added up on the way, with the key records.
    """
    sums = list(_counted(table, c))

    def records(df: DataFrame, loaded: bool) -> DataFrame:
        digest = F.sha2(tx.clean_text(F.col(c.text)), 256)
        nothing, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
        counted = _counted(df, c) if loaded else {}
        kinds = [("key", c.key, digest), ("metadata", c.metadata, nothing)]
        kinds += [("speaker", c.speaker, nothing)] if loaded else []
        return df.select(F.inline(F.array(*[F.struct(
            F.lit(kind).alias("kind"), F.col(column).cast("string").alias("value"), text.alias("digest"),
            F.lit(int(loaded)).alias("loaded"),
            *[(counted[n] if kind == "key" and n in counted else zero).alias(n) for n in sums],
        ) for kind, column, text in kinds])))

    here, there = F.col("loaded") == 1, F.col("loaded") == 0
    groups = records(table, True).unionByName(records(expected, False)).groupBy("kind", "value").agg(
        F.count_if(here).alias("here"), F.count_if(there).alias("there"),
        (F.min("digest") != F.max("digest")).alias("differs"),  # the key's texts are not all alike
        *[F.sum(n).alias(n) for n in sums])
    key, known = F.col("kind") == "key", F.col("value").isNotNull()
    absent = known & (F.col("here") == 0)
    one = groups.agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in sums],
        F.count_if((F.col("kind") == "speaker") & known).alias("speakers"),
        F.coalesce(F.sum(F.when(key, F.col("there"))), F.lit(0)).alias("raw"),
        F.count_if(key & absent).alias("ids"),
        F.count_if((F.col("kind") == "metadata") & absent).alias("values"),
        F.count_if(key & known & (F.col("here") > 0) & (F.col("there") > 0) & F.col("differs")).alias("texts"))
    off = F.abs(F.col("raw") - F.col("rows"))
    allowed = F.greatest(F.lit(1), F.floor(F.lit(0.05) * F.col("raw")))
    return _as_report(one, [
        *_row_checks(sums, c), ("count_tolerance", off, allowed, off <= allowed),
        *[(n, F.col(v), F.lit(0), F.col(v) <= 0) for n, v in (("ids_exist", "ids"), ("metadata_exist", "values"), ("text_equal", "texts"))],
    ])
