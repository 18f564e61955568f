"""Word search and proximity search. Whole texts, no shuffle before the result.

A search analyses query and text alike. ``mode='french'``, the default, compares words after
elision and by stem, and takes no notice of stop words, which still count as places;
``mode='token'`` compares lower-case tokens. Query terms are analysed once, on the driver, and
enter the plan as literals.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hemicycle.functions import french
from hemicycle.functions import text as tx
from hemicycle.functions.vectors import let
from hemicycle.session import checkpointed

FRENCH, TOKEN = "french", "token"
#: Repeated keys up to which they are broadcast.
BROADCAST_KEYS = 1_000_000


def query_words(query: str) -> list[str]:
    """The words of a query, under the same rule as the text's tokens."""
    kept = "".join(c for c in query.lower() if c.isalnum() or c == "_" or c.isspace())
    return kept.split()


@dataclass(frozen=True)
class Term:
    """Words that have to stand at given places after each other: a word, or a phrase."""

    words: tuple[str, ...]
    places: tuple[int, ...]
    mode: str

    @property
    def length(self) -> int:
        return self.places[-1] + 1

    def matches(self, token: Column, n: int) -> Column:
        """A token is the term's n-th word."""
        if self.mode == TOKEN:
            return token == F.lit(self.words[n])
        # only words that begin like the stem are stemmed; most are told apart by their first letter
        return self.likely(token, n) & self.fits(token, n)

    def likely(self, token: Column, n: int) -> Column:
        """In French mode: a token begins like the term's n-th word."""
        first = F.substring(token, 1, 1).isin(*french.may_begin_with(self.words[n]))
        return first & token.rlike("^" + french.may_stem_to(self.words[n]))

    def fits(self, token: Column, n: int) -> Column:
        """In French mode: a token has the stem of the term's n-th word, which may be that word itself."""
        word = self.words[n]
        stemmed = french.stem(token) == F.lit(word)
        return (token == F.lit(word)) | stemmed if french.light_stem(word) == word else stemmed


def tokens_of(text: Column, mode: str) -> Column:
    return french.french_tokens(text) if mode == FRENCH else tx.tokenize(text)


def analysed(query: str, mode: str) -> list[tuple[int, str]]:
    """(place, word) of a query's words; in French mode stems, without stop words."""
    if mode == TOKEN:
        return list(enumerate(query_words(query)))
    if mode != FRENCH:
        raise ValueError(f"mode is {FRENCH!r} or {TOKEN!r}, not {mode!r}")
    return [(i, french.light_stem(w)) for i, w in enumerate(french.query_tokens(query)) if w not in french.STOP_WORDS]


def term(query: str, mode: str = FRENCH) -> Term:
    """A search term of one or several words; stop words inside leave their place open."""
    found = analysed(query, mode)
    if not found:
        raise ValueError(f"no word to search for in {query!r}")
    first = found[0][0]
    return Term(tuple(w for _, w in found), tuple(i - first for i, _ in found), mode)


def any_word(tokens: Column, query: str, mode: str) -> Column:
    """Any word of the query is among the tokens; a query without words matches nothing."""
    words = sorted({w for _, w in analysed(query, mode)})
    if not words:
        return F.lit(False)
    if mode == TOKEN:
        if len(words) == 1:
            return F.array_contains(tokens, words[0])
        return F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words]))
    single = [Term((w,), (0,), mode) for w in words]
    return F.exists(F.array_distinct(tokens), lambda t: reduce(lambda a, b: a | b, [x.matches(t, 0) for x in single]))


def may_match(text: Column, query: str, mode: str) -> Column:
    """Cheap test of the whole text: some word begins as one of the query's would."""
    words = sorted({w for _, w in analysed(query, mode)})
    if not words:
        return F.lit(False)
    if mode == FRENCH:
        return F.lower(text).rlike(french.may_contain(words))
    # signs inside a word are deleted, so only its first letter is certain
    return F.lower(text).rlike("|".join(sorted({re.escape(w[0]) for w in words})))


def has_word(text: str, query: str | None, mode: str = FRENCH) -> Column:
    """Any word of the query occurs in the text; no query matches everything.

    In French mode only the words that may have a stem of the query are taken out of the text,
    analysed and stemmed.
    """
    if not (query or "").strip():
        return F.lit(True)
    column = F.col(text)
    if mode == TOKEN:
        return any_word(tokens_of(column, mode), query, mode)
    stems = sorted({w for _, w in analysed(query, mode)})
    if not stems:
        return F.lit(False)
    likely = F.regexp_extract_all(F.lower(column), F.lit(french.may_contain(stems)), 0)
    return F.coalesce(any_word(tokens_of(F.array_join(F.array_distinct(likely), " "), mode), query, mode), F.lit(False))


def match_word(df: DataFrame, text: str, query: str | None, mode: str = FRENCH) -> DataFrame:
    return df.where(has_word(text, query, mode))


def filter_topic(df: DataFrame, text: str, topic: str | None, mode: str = FRENCH) -> DataFrame:
    """Optional topic in front of an aggregate."""
    return df if topic is None else match_word(df, text, topic, mode)


def bind(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row, however often it is used later.

    A plain projection may be inlined into filters and into lambda bodies, where an
    expensive expression would run once per array element; a one-element generator is not.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def positions(tokens: Column, wanted: Term) -> Column:
    """Sorted 1-based places at which the term starts. The first word is looked for, the others
    only beside its hits."""
    def places(matches: Callable[[Column], Column]) -> Column:
        return F.filter(F.transform(tokens, lambda t, i: F.when(matches(t), i + 1)), lambda p: p.isNotNull())

    if wanted.mode == TOKEN:
        first = places(lambda t: wanted.matches(t, 0))
    else:
        # of a text, every likely word is stemmed once
        likely = F.array_distinct(F.filter(tokens, lambda t: wanted.likely(t, 0)))
        first = let(F.filter(likely, lambda t: wanted.fits(t, 0)), lambda found: places(lambda t: F.array_contains(found, t)))

    def whole(p: Column) -> Column:
        rest = [wanted.matches(F.get(tokens, p - 1 + place), n) for n, place in enumerate(wanted.places) if n]
        return F.coalesce(reduce(lambda a, b: a & b, rest), F.lit(False))

    return F.filter(first, whole) if len(wanted.words) > 1 else first


def least_gap(starts_a: Column, length_a: int, starts_b: Column, length_b: int) -> Column:
    """Fewest words between a span of a and one of b that do not overlap, in either order; NULL
    if there is no such pair.

    One sweep over the merged list of places: where a span opens, the nearest one of the other
    kind that has closed before is known. No pair of spans is built.
    """
    def events(starts: Column, length: int, kind: str) -> Column:
        # at one place spans close (0) before others open (1)
        shape = [F.lit(kind).alias("kind")]
        closing = F.transform(starts, lambda p: F.struct((p + length).alias("at"), F.lit(0).alias("opens"), *shape))
        opening = F.transform(starts, lambda p: F.struct(p.alias("at"), F.lit(1).alias("opens"), *shape))
        return F.concat(closing, opening)

    merged = F.sort_array(F.concat(events(starts_a, length_a, "a"), events(starts_b, length_b, "b")))
    nothing = F.lit(None).cast("int")
    start = F.struct(nothing.alias("a"), nothing.alias("b"), nothing.alias("best"))

    def step(state: Column, e: Column) -> Column:
        closes = e["opens"] == 0
        other = F.when(e["kind"] == "a", state["b"]).otherwise(state["a"])
        return F.struct(
            F.when(closes & (e["kind"] == "a"), e["at"]).otherwise(state["a"]).alias("a"),
            F.when(closes & (e["kind"] == "b"), e["at"]).otherwise(state["b"]).alias("b"),
            F.when(closes, state["best"]).otherwise(F.least(state["best"], e["at"] - other)).alias("best"))

    return F.aggregate(merged, start, step)["best"]


def match_proximity(
    df: DataFrame, text: str, term_a: str, term_b: str, slop: int = 20, mode: str = FRENCH
) -> DataFrame:
    """Both terms, of one or several words, with at most ``slop`` words in between, in either
    order. Adds nothing to the rows."""
    return proximity(df, text, term_a, term_b, mode).where(F.col("least_gap") <= slop).drop("least_gap")


def proximity(df: DataFrame, text: str, term_a: str, term_b: str, mode: str = FRENCH) -> DataFrame:
    """The rows that have both terms apart from each other, with ``least_gap``: the fewest words
    between them."""
    a, b = term(term_a, mode), term(term_b, mode)
    likely = df.where(may_match(F.col(text), term_a, mode) & may_match(F.col(text), term_b, mode))
    marked = bind(likely, "_tokens", tokens_of(F.col(text), mode))
    for name, wanted in (("_a", a), ("_b", b)):
        marked = bind(marked, name, positions(F.col("_tokens"), wanted)).where(F.size(name) > 0)
    gap = least_gap(F.col("_a"), a.length, F.col("_b"), b.length)
    return bind(marked, "least_gap", gap).where("least_gap IS NOT NULL").drop("_tokens", "_a", "_b")


def similar_words_paragraphs(
    df: DataFrame, words: DataFrame, key: str, text: str, main: str, slop: int = 20, mode: str = FRENCH
) -> DataFrame:
    """Per similar word (``word``, ``score``): how many paragraphs have it near ``main``.

    Words near a hit of ``main`` are listed inside each paragraph and met with the word
    table by equality, so no pair of paragraph and word is built that does not match.
    Words without a paragraph keep a zero row.
    """
    pairs = near_word_pairs(df, words, key, text, main, slop, mode)
    counted = pairs.groupBy("word").agg(F.count("*").alias("paragraphs"))
    return words.select("word", "score").join(counted, "word", "left").select(
        "word", "score", F.coalesce("paragraphs", F.lit(0)).alias("paragraphs")
    )


def near_word_pairs(
    df: DataFrame, words: DataFrame, key: str, text: str, main: str, slop: int = 20, mode: str = FRENCH
) -> DataFrame:
    """(word, key) rows: the paragraphs behind ``similar_words_paragraphs``. ``main`` is a term
    of one or several words; the words of the table are compared by stem in French mode."""
    wanted = term(main, mode)
    likely = df.select(key, text).where(may_match(F.col(text), main, mode))
    marked = bind(likely, "_tokens", tokens_of(F.col(text), mode))
    marked = bind(marked, "_spots", positions(F.col("_tokens"), wanted)).where(F.size("_spots") > 0)

    def around(p: Column) -> Column:
        begin = F.greatest(p - (slop + 1), F.lit(1))
        return F.concat(F.slice("_tokens", begin, p - begin), F.slice("_tokens", p + wanted.length, F.lit(slop + 1)))

    near = F.array_distinct(F.flatten(F.transform("_spots", around)))
    stemmed = (lambda c: french.stem(F.lower(c))) if mode == FRENCH else (lambda c: c)
    found = marked.select(key, F.explode(near).alias("_token")).select(key, stemmed(F.col("_token")).alias("_term")).distinct()
    listed = words.select("word").distinct().select("word", stemmed(F.col("word")).alias("_term"))
    return found.join(listed, "_term").select("word", key)


def word_counts(df: DataFrame, key: str, words: Column) -> DataFrame:
    """(key, word, n): how often each word occurs in the rows of a key.

    Words are counted inside their row and do not travel; only the rows of keys
    that occur more than once (NULL is one key) meet in an exchange, as counts.
    """
    repeated = checkpointed(df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).where("_n > 1").select("_key"))
    n = repeated.count()

    schema = T.StructType([df.schema[key], T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spelled = batch.column(1).flatten().dictionary_encode()
            rows = np.repeat(np.arange(batch.num_rows), batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            met, counts = np.unique((rows << 32) | spelled.indices.to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(met >> 32)), spelled.dictionary.take(pa.array(met & 0xFFFFFFFF)), pa.array(counts)],
                names=[key, "word", "n"])

    def counted(rows: DataFrame) -> DataFrame:
        return rows.select(key, words.alias("_words")).mapInArrow(run, schema)

    if not n:
        return counted(df)
    known = F.broadcast(repeated) if n <= BROADCAST_KEYS else repeated
    same = F.col(key).eqNullSafe(F.col("_key"))
    more = counted(df.join(known, same, "left_semi")).groupBy(key, "word").agg(F.sum("n").alias("n"))
    return counted(df.join(known, same, "left_anti")).unionByName(more)


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, n): French terms of each text. Words are counted first; every distinct word
    of the table is then stemmed once, and its stem joined back."""
    counted = word_counts(df, key, french.french_words(F.col(text))).select(
        key, F.col("word").alias("_word"), F.col("n").alias("_n"))
    stems = counted.select("_word").distinct().select("_word", french.stem(F.col("_word")).alias("term"))
    return counted.join(stems, "_word").groupBy(key, "term").agg(F.sum("_n").alias("n"))
