"""URL filter: longest-prefix rules first, then a Bloom filter cascade over hosts.

A cascade gives exact membership for a closed universe of keys. Level 1 holds the listed
keys; level 2 holds those unlisted keys that level 1 wrongly accepts; level 3 the listed
keys that level 2 wrongly accepts; and so on until a level has no wrong key. A key is
decided by the first level that rejects it. Since the universe is every distinct host of
the table itself, each verdict is exact, and rows are judged without a join: the levels are
scalar values (arrays of 64-bit words) inside the projection.

Size: level 1 takes about 1.44 bits per hash function and listed key, all later levels
together about as many again. A list whose first level would pass ``max_bits`` is looked up
by an equi-join instead, which gives the same verdicts.

Defined cases: a null url, or one without ``://``, has empty host and path, meets no rule
and is never listed; repeated urls are judged alike; an empty table gives no rows; other
columns of the table, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemicycle.llm.common import cut, hinted, wanted

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path): fits the host and its subdomains where the path starts so.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Names of sites; every host that has one of them as a label is listed.
LISTED_SITES = ("spam-farm", "cheap-pills", "casino-win", "ads-track", "adult-x", "free-bets")
MAX_BITS = 1 << 26
MAX_LEVELS = 64


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``; A-Z in lower case."""
    host = F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as struct (rule, verdict); null if none does."""
    found = None
    for verdict, site, prefix in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == site) | host.endswith(f".{site}")) & path.startswith(prefix)
        value = F.struct(F.lit(site + prefix).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    empty = F.lit(None).cast("struct<rule:string,verdict:string>")
    return empty if found is None else found.otherwise(empty)


@dataclass
class Level:
    """One Bloom filter: a one-row frame with its words, and how keys map to bits."""

    number: int
    bits: int
    hashes: int
    words: DataFrame

    def positions(self, key: Column) -> list[Column]:
        return [
            F.pmod(F.xxhash64(key, F.lit(self.number), F.lit(i)), F.lit(self.bits))
            for i in range(self.hashes)
        ]

    def holds(self, key: Column) -> Column:
        words, held = self.words.scalar(), F.lit(True)
        for at in self.positions(key):
            word = F.element_at(words, (F.floor(at / 64) + 1).cast("int"))
            held = held & (F.getbit(word, (at % 64).cast("int")) == 1)
        return held


def build_level(keys: DataFrame, number: int, bits: int, hashes: int) -> Level:
    """Filter over ``keys.key``: set bits are grouped by word, words are put in order."""
    level = Level(number, bits, hashes, keys)
    at = F.explode(F.array(*level.positions(F.col("key")))).alias("at")
    set_words = (
        keys.select(at)
        .groupBy(F.floor(F.col("at") / 64).cast("long").alias("id"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 AS INT))")).alias("word"))
    )
    every = keys.sparkSession.range(0, bits // 64, 1, 1)
    ordered = F.array_sort(F.collect_list(F.struct("id", F.coalesce("word", F.lit(0)).alias("word"))))
    level.words = cut(
        every.join(set_words, "id", "left").agg(F.transform(ordered, lambda x: x["word"]).alias("words"))
    )
    return level


def build_cascade(universe: DataFrame, max_bits: int = MAX_BITS) -> list[Level] | None:
    """Levels for ``universe`` (key, listed): distinct keys. None: the list is too large."""
    sizes = universe.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first()
    n_listed, n_other = int(sizes[0]), int(sizes[1])
    hashes = max(1, math.ceil(math.log2(max(2, n_other / max(1, n_listed)))) + 1)
    if 1.44 * hashes * n_listed > max_bits:
        return None
    levels: list[Level] = []
    inside, outside = universe.where("listed"), universe.where(~F.col("listed"))
    count = n_listed
    while count:
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("the cascade does not end: two keys have the same hashes")
        k = hashes if not levels else 1
        bits = 64 * math.ceil(1.44 * k * count / 64)
        level = build_level(inside, len(levels) + 1, bits, k)
        levels.append(level)
        wrong = cut(outside.where(level.holds(F.col("key"))))
        inside, outside, count = wrong, inside, wrong.count()
    return levels


def listed_in(levels: Sequence[Level], key: Column) -> Column:
    """Whether a key of the universe is listed: odd first rejection means no, even yes."""
    verdict = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        verdict = F.when(level.holds(key), verdict).otherwise(F.lit(level.number % 2 == 0))
    return verdict


def has_label(host: Column, labels: Sequence[str]) -> Column:
    return F.arrays_overlap(F.split(host, r"\."), F.array(*[F.lit(x) for x in labels]))


def filter_urls(
    pages: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    listed: DataFrame | None = None,
    rules: Sequence[tuple[str, str, str]] = RULES,
    sites: Sequence[str] = LISTED_SITES,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """Every page with host, path, the rule that fits and the verdict.

    ``listed`` has the blocked hosts in ``key``; without it, every host of the table that
    carries a label of ``sites`` is listed.
    """
    judged = wanted(pages, page_id=id_column, url=url_column).select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    hosts = judged.where("host <> ''").groupBy(F.col("host").alias("key")).agg(F.lit(1).alias("n"))
    if listed is None:
        universe = hosts.select("key", has_label(F.col("key"), sites).alias("listed"))
    else:
        keys = listed.select("key").distinct().withColumn("found", F.lit(True))
        universe = hosts.join(keys, "key", "left").select("key", F.col("found").isNotNull().alias("listed"))
    universe = cut(universe)
    levels = build_cascade(universe, max_bits)
    if levels is None:
        blocked = universe.where("listed").select(F.col("key").alias("host"), F.lit(True).alias("blocked"))
        judged = judged.join(hinted(blocked), "host", "left")
        is_listed = F.coalesce("blocked", F.lit(False))
    else:
        is_listed = (F.col("host") != "") & listed_in(levels, F.col("host"))
    rule = best_rule(F.col("host"), F.col("path"), rules)
    return judged.select("page_id", "host", "path", rule.alias("best"), is_listed.alias("is_listed")).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.when(F.col("is_listed"), "block").otherwise("allow")).alias("verdict"),
    )


def _sql_rules() -> str:
    cases = []
    for verdict, site, prefix in sorted(RULES, key=lambda r: -len(r[1] + r[2])):
        cases.append(
            f"WHEN (host = '{site}' OR ends_with(host, '.{site}')) AND starts_with(path, '{prefix}') "
            f"THEN {{'rule': '{site}{prefix}', 'verdict': '{verdict}'}}"
        )
    return "CASE " + " ".join(cases) + " END"


SQL = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest
  FROM pages),
split AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM rest),
ruled AS (SELECT *, {_sql_rules()} AS best FROM split)
SELECT page_id, host, path, best.rule AS rule,
       coalesce(best.verdict, CASE WHEN list_has_any(string_split(host, '.'), {list(LISTED_SITES)})
                              THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled
"""
