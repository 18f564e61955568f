"""Quality rules judged by host: one document fails rules, a host is judged by how often.

Words are runs of characters other than blank and 09 to 0D. Every whole text is measured once
(counts of words, characters, signs, repeated lines and repeated five-word windows) and tried
by ``RULES``. Failures are added up by host; a host's rate for a rule is shrunk towards the
rate of all rows by a beta prior whose weight is estimated from the hosts themselves (moments:
the spread between hosts beyond what chance gives). A host that fails few documents in few
rows keeps its documents; one whose shrunk rate for any rule is over ``LIMIT`` loses them all.
The verdict is joined back to the documents of the host.

The measuring is expressions over one row, so texts never move. Only the narrow measures are
written and grouped (partially before the shuffle, so a host with a third of all rows sends
one row a task); the list of rejected hosts is broadcast if its bytes are counted to be few,
else joined by Spark, which splits a hot host.

Defined cases: a null text has no words; a text without words fails the base rules; rows
without a host (null) are judged by the base rules alone and enter no rate; each row is
judged by itself, so repeated rows and ids, null ids included, stay rows; windows are compared
by 64 bits of hash within a text; a very long text is one row's arrays, linear in its words;
a rate equal to the limit is not over it; an empty table gives no rows; only the named columns
are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemicycle.llm.common import cut, small_enough, text_of, wanted

#: White space of the word rules.
SPACES = " \t\n\x0b\x0c\r"
SIGNS = "#*$%&|<>"
WINDOW = 5
#: Shrunk failure rate over which a host is rejected.
LIMIT = 0.5
#: Weight of the prior, in rows: never less, nor more.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1e6

#: Rule: when a document fails it. The first two are the base rules.
RULES = {
    "few_words": "n_words < 10",
    "repetition": "100 * n_repeat_words > 20 * n_words",
    "word_length": "word_chars < 3 * n_words OR word_chars > 12 * n_words",
    "signs": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
}
BASE = ("few_words", "repetition")


def words_of(text: Column) -> Column:
    body = F.btrim(text, F.lit(SPACES))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, r"[\x20\x09-\x0D]+"))


def lines_of(text: Column) -> Column:
    """Lines that have a word."""
    return F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(SPACES)) != "")


def window_hashes(hashes: Column) -> Column:
    """One hash for every five consecutive words; ``hashes``: those of the words."""
    starts = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0)))
    return F.transform(starts, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, WINDOW)]))


def repeated_starts(ranked: Column) -> Column:
    """Sorted places of windows that occur twice or more; ``ranked``: sorted (h, at)."""
    def again(x: Column, i: Column) -> Column:
        beside = [F.get(ranked, i + k)["h"] == x["h"] for k in (-1, 1)]
        return F.coalesce(beside[0], F.lit(False)) | F.coalesce(beside[1], F.lit(False))

    return F.sort_array(F.transform(F.filter(ranked, again), lambda x: x["at"]))


def covered(starts: Column) -> Column:
    """Number of words that windows at these sorted places cover."""
    own = F.transform(starts, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW))))
    return F.aggregate(own, F.lit(0).cast("long"), lambda total, n: total + n)


def measure(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text",
            host_column: str = "source") -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words)."""
    rows = wanted(documents, doc_id=id_column, host=host_column, text=text_column)
    rows = rows.select("doc_id", "host", text_of("text").alias("text"))
    rows = rows.select("doc_id", "host", "text", words_of(F.col("text")).alias("words"),
                       lines_of(F.col("text")).alias("lines"))
    rows = rows.select(
        "doc_id", "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SIGNS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    known = [c for c in rows.columns if c != "hashes"]
    rows = rows.select(*known, window_hashes(F.col("hashes")).alias("windows"))
    # only texts that repeat a window pay for sorting
    ranked = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    unique = F.size(F.array_distinct("windows")) == F.size("windows")
    rows = rows.select(*known, F.when(~unique, ranked).alias("ranked"))
    rows = rows.select(*known, repeated_starts(F.col("ranked")).alias("starts"))
    return rows.select(*known, F.coalesce(covered(F.col("starts")), F.lit(0)).cast("long").alias("n_repeat_words"))


def failures(measures: DataFrame) -> DataFrame:
    """Rows per host and, for every rule, how many of them fail it."""
    return measures.where("host IS NOT NULL").groupBy("host").agg(
        F.count("*").alias("n"),
        *[F.sum(F.expr(test).cast("long")).alias(rule) for rule, test in RULES.items()])


def beta_prior(hosts: DataFrame, rules: tuple[str, ...] = tuple(RULES)) -> dict[str, tuple[float, float]]:
    """Rule: (mean, weight) of the beta prior of failure rates, by moments over all hosts.

    ``weight`` is the number of rows the prior counts for. One row comes to the driver.
    """
    sums = hosts.agg(
        F.count("*").alias("hosts"), F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
        *[F.sum(rule).alias(f"{rule}_k") for rule in rules],
        *[F.sum(F.col(rule).cast("double") * F.col(rule) / F.col("n")).alias(f"{rule}_kk") for rule in rules],
    ).first()
    if not sums["hosts"]:
        return {rule: (0.0, MOST_WEIGHT) for rule in rules}
    total, found = sums["n"], {}
    chance = (sums["hosts"] - 1) / total  # of the spread, what independent rows give
    between = 1 - sums["nn"] / total / total
    for rule in rules:
        mean = sums[f"{rule}_k"] / total
        spread = sums[f"{rule}_kk"] / total - mean * mean
        even = mean * (1 - mean)
        alike = (spread - even * chance) / (even * (between - chance)) if even * (between - chance) > 1e-12 else 0.0
        weight = 1 / alike - 1 if alike > 0 else MOST_WEIGHT
        found[rule] = (mean, min(max(weight, LEAST_WEIGHT), MOST_WEIGHT))
    return found


def rejected_hosts(hosts: DataFrame, limit: float = LIMIT) -> DataFrame:
    """(host, failed_rule): hosts over the limit, with the first rule that rejects them."""
    over = F.coalesce(*[
        F.when((F.col(rule) + mean * weight) / (F.col("n") + weight) > limit, F.lit(rule))
        for rule, (mean, weight) in beta_prior(hosts).items()])
    return hosts.select("host", over.alias("failed_rule")).where("failed_rule IS NOT NULL")


def judge(documents: DataFrame, limit: float = LIMIT, id_column: str = "doc_id", text_column: str = "text",
          host_column: str = "source") -> DataFrame:
    """Measures and verdict of every document; ``host_rule`` names the rule its host failed."""
    measures = cut(measure(documents, id_column, text_column, host_column))
    rejected = cut(rejected_hosts(cut(failures(measures)), limit))
    base_failed = F.expr(" OR ".join(f"({RULES[rule]})" for rule in BASE))
    joined = measures.join(
        small_enough(rejected.withColumnRenamed("host", "__host"), "__host"), F.col("host") == F.col("__host"), "left")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (~base_failed & F.col("failed_rule").isNull()).alias("kept"),
        F.col("failed_rule").alias("host_rule"))


def keep_good(documents: DataFrame, limit: float = LIMIT, id_column: str = "doc_id", text_column: str = "text",
              host_column: str = "source") -> DataFrame:
    """The documents themselves, without those that fail the base rules or whose host does.

    Here the texts are measured twice: once for the rates, once where they are filtered.
    """
    hosts = cut(failures(measure(documents, id_column, text_column, host_column)))
    rejected = cut(rejected_hosts(hosts, limit)).select(F.col("host").alias("__host"))
    whole = documents.select(F.struct("*").alias("__row"))
    tried = measure(whole.select("__row", F.col(f"__row.`{text_column}`").alias("text"),
                                 F.col(f"__row.`{host_column}`").alias("host")), "__row", "text", "host")
    base_failed = F.expr(" OR ".join(f"({RULES[rule]})" for rule in BASE))
    kept = tried.where(~base_failed).join(
        small_enough(rejected, "__host"), F.col("host") == F.col("__host"), "left_anti")
    return kept.select(*[F.col(f"doc_id.`{c}`").alias(c) for c in documents.columns])


SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
cutup AS (
  SELECT rid, doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM texts),
windows AS (
  SELECT rid, p, words[p:p + 4] AS w
  FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS p FROM cutup)),
again AS (SELECT rid, p FROM windows QUALIFY count(*) OVER (PARTITION BY rid, w) > 1),
repeats AS (
  SELECT rid, count(DISTINCT p + k) AS n FROM again, (SELECT unnest(range(5)) AS k) GROUP BY rid),
measured AS (
  SELECT c.rid, doc_id, host, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM cutup c LEFT JOIN repeats r ON c.rid = r.rid),
tried AS (
  SELECT *, n_words < 10 AS few_words, 100 * n_repeat_words > 20 * n_words AS repetition,
    word_chars < 3 * n_words OR word_chars > 12 * n_words AS word_length,
    10 * n_symbols > n_words AS signs, 10 * n_dup_lines > 3 * n_lines AS dup_lines FROM measured),
long AS (
  SELECT host, unnest([{'pos': 1, 'rule': 'few_words', 'bad': few_words}, {'pos': 2, 'rule': 'repetition', 'bad': repetition},
    {'pos': 3, 'rule': 'word_length', 'bad': word_length}, {'pos': 4, 'rule': 'signs', 'bad': signs},
    {'pos': 5, 'rule': 'dup_lines', 'bad': dup_lines}]) AS t
  FROM tried WHERE host IS NOT NULL),
hosts AS (
  SELECT host, t.pos AS pos, t.rule AS rule, count(*)::DOUBLE AS n, sum(t.bad::INT)::DOUBLE AS k
  FROM long GROUP BY host, t.pos, t.rule),
sums AS (
  SELECT rule, count(*) AS h, sum(n) AS n, sum(k) / sum(n) AS mean, (count(*) - 1) / sum(n) AS chance,
    1 - sum(n * n) / sum(n) / sum(n) AS between_hosts, sum(k * k / n) / sum(n) - (sum(k) / sum(n)) ** 2 AS spread
  FROM hosts GROUP BY rule),
shares AS (
  SELECT rule, mean, CASE WHEN mean * (1 - mean) * (between_hosts - chance) > 1e-12
    THEN (spread - mean * (1 - mean) * chance) / (mean * (1 - mean) * (between_hosts - chance)) ELSE 0 END AS alike
  FROM sums),
priors AS (
  SELECT rule, mean, least(greatest(CASE WHEN alike > 0 THEN 1 / alike - 1 ELSE 1e6 END, 1), 1e6) AS weight FROM shares),
rejected AS (
  SELECT host, arg_min(h.rule, pos) AS host_rule FROM hosts h JOIN priors p ON h.rule = p.rule
  WHERE (k + mean * weight) / (n + weight) > 0.5 GROUP BY host)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (few_words OR repetition) AS base_failed, NOT (few_words OR repetition) AND host_rule IS NULL AS kept, host_rule
FROM tried t LEFT JOIN rejected r ON t.host = r.host
"""
