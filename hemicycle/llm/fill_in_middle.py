"""Fill-in-the-middle transformation with a learned rank index over token boundaries.

A text is cut into n tokens: a word (run of characters other than blank and 09 to 0D) with the
white space before it, or the white space at the end. Three seeded numbers of a document say
whether it is transformed, in which form, and after how many tokens prefix and middle end.

Where token k ends is read from a rank index of the text: all boundary offsets, by rank, are
covered by straight segments, each within ``ERROR`` code points of every boundary it covers
(the cone of slopes through its first point shrinks until a boundary leaves it empty), and one
signed byte a boundary stores what the prediction misses. A cut is a prediction plus its
residual, so it is exact. The index takes about a byte a token and lives no longer than its text.

Only the text goes to Python, and only numbers come back; texts are put together by Spark's
own expressions. No row meets another: there is no shuffle, and a lost executor costs its tasks.

Defined cases: a null text is empty; an empty text, or one that has a marker, stays plain; a
null id counts as the empty string in the seed; each row is a document of its own, so repeated
rows and ids give equal results; texts are taken whole, of any length; cuts at the same token
leave an empty middle; an empty table gives no rows; only the named columns are read, so
others may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemicycle.llm.common import text_of, wanted

SEED, PERCENT_FIM, PERCENT_SPM = 42, 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points by which a segment may miss a boundary; with rounding it fits a signed byte.
ERROR = 120
#: Boundaries that are tried at first for one segment; doubled while they fit.
FIRST_TRY = 256


def boundary_offsets(text: bytes) -> np.ndarray:
    """Code points before each token boundary, 0 first; n tokens have n + 1 boundaries."""
    b = np.frombuffer(text, np.uint8)
    if not len(b):
        return np.zeros(1, np.int64)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1  # a word stops here
    ends = np.concatenate([[0], ends, [len(b)]])
    later = (b & 0xC0) == 0x80  # bytes that continue a code point
    return ends - np.concatenate([[0], np.cumsum(later)])[ends] if later.any() else ends


@dataclass
class RankIndex:
    """Offsets of all boundaries: segments (first rank, its offset, slope) and residuals."""

    first: np.ndarray
    start: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    def offset(self, rank: int) -> int:
        s = int(np.searchsorted(self.first, rank, "right")) - 1
        return int(self.start[s] + np.floor(self.slope[s] * (rank - self.first[s]))) + int(self.residual[rank])


def one_segment(offsets: np.ndarray, at: int, error: int) -> tuple[int, float]:
    """The rank after the longest segment from rank ``at``, and the segment's slope."""
    low, high, end, tries = 0.0, np.inf, at + 1, FIRST_TRY
    while end < len(offsets):
        part = offsets[end: end + tries] - offsets[at]
        run = np.arange(end - at, end - at + len(part))
        lows = np.maximum.accumulate(np.maximum((part - error) / run, low))
        highs = np.minimum.accumulate(np.minimum((part + error) / run, high))
        empty = lows > highs
        if empty.any():
            stop = int(empty.argmax())
            if stop:
                low, high = lows[stop - 1], highs[stop - 1]
            end += stop
            break
        low, high, end, tries = lows[-1], highs[-1], end + len(part), 2 * tries
    return end, (low + high) / 2 if end > at + 1 else 0.0


def fit(offsets: np.ndarray, error: int = ERROR) -> RankIndex:
    """Cover all boundaries with segments, then store what each prediction misses."""
    first, slope, at = [], [], 0
    while at < len(offsets):
        first.append(at)
        at, rise = one_segment(offsets, at, error)
        slope.append(rise)
    starts = np.array(first)
    run = np.arange(len(offsets)) - np.repeat(starts, np.diff(np.append(starts, len(offsets))))
    which = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(offsets))))
    rise = np.array(slope)
    missed = offsets - offsets[starts][which] - np.floor(rise[which] * run).astype(np.int64)
    if np.abs(missed).max() > 127:
        raise ArithmeticError("a segment misses a boundary by more than its error")
    return RankIndex(starts, offsets[starts], rise, missed.astype(np.int8))


def cuts(text: Column, h1: Column, h2: Column, wanted_cuts: Column) -> Column:
    """struct<n, a, b, segments>: tokens, code points before both cuts, segments of the index.

    Rows whose cuts are not wanted only have their tokens counted.
    """
    kind = pa.struct([("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("segments", pa.int64())])

    @F.arrow_udf("n long, a long, b long, segments long")
    def find(texts: pa.Array, first: pa.Array, second: pa.Array, wants: pa.Array) -> pa.Array:
        rows = []
        for value, x, y, cut in zip(texts.cast(pa.binary()), first.to_pylist(), second.to_pylist(), wants.to_pylist()):
            offsets = boundary_offsets(value.as_py())
            n = len(offsets) - 1
            if not cut:
                rows.append({"n": n, "a": None, "b": None, "segments": None})
                continue
            index = fit(offsets)
            one, two = sorted((x % (n + 1), y % (n + 1)))
            rows.append({"n": n, "a": index.offset(one), "b": index.offset(two), "segments": len(index.first)})
        return pa.array(rows, kind)

    return find(text, h1, h2, wanted_cuts)


def seeded(digest: Column, group: int) -> Column:
    """The 8-digit group (from 0) of a hex digest, unsigned."""
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


def transform(documents: DataFrame, seed: int = SEED, percent_fim: int = PERCENT_FIM, percent_spm: int = PERCENT_SPM,
              id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, segments, output): the training texts."""
    rows = wanted(documents, doc_id=id_column, text=text_column)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = rows.select("doc_id", text_of("text").alias("text"), digest.alias("digest"))
    text = F.col("text")
    stays = (text == "") | (seeded(F.col("digest"), 2) % 100 >= percent_fim)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        stays = stays | text.contains(marker)
    spm = seeded(F.col("digest"), 3) % 100 < percent_spm
    rows = rows.select(
        "doc_id", "text", "digest", F.when(stays, "plain").when(spm, "spm").otherwise("psm").alias("form"))
    cut = cuts(text, seeded(F.col("digest"), 0), seeded(F.col("digest"), 1), F.col("form") != "plain")
    rows = rows.select("doc_id", "text", "form", cut.alias("cut"))
    a, b = F.col("cut.a"), F.col("cut.b")
    one, two = F.substring(text, F.lit(1), a), F.substring(text, a + 1, b - a)
    rest = F.substring(text, b + 1, F.length(text))
    output = (
        F.when(F.col("form") == "plain", text)
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), rest, F.lit(PREFIX), one, F.lit(MIDDLE), two))
        .otherwise(F.concat(F.lit(PREFIX), one, F.lit(SUFFIX), rest, F.lit(MIDDLE), two)))
    return rows.select(
        "doc_id", F.col("cut.n").alias("n"), "form", a.alias("prefix_chars"), (b - a).alias("middle_chars"),
        F.col("cut.segments").alias("segments"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text, from output and form alone: parts hold no marker, so each is found once."""
    def after(marker: str) -> Column:
        return F.substring(output, F.locate(marker, output) + len(marker), F.length(output))

    def between(marker: str, following: str) -> Column:
        return F.substring_index(after(marker), following, 1)

    return (
        F.when(form == "plain", output)
        .when(form == "spm", F.concat(between(PREFIX, MIDDLE), after(MIDDLE), between(SUFFIX, PREFIX)))
        .otherwise(F.concat(between(PREFIX, SUFFIX), after(MIDDLE), between(SUFFIX, MIDDLE))))


def digests(documents: DataFrame) -> DataFrame:
    """The transformation with SHA-256 of output and of the restored text in their place."""
    done = transform(documents)
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
cutup AS (
  SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens,
    ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3,
    ('0x' || d[25:32])::BIGINT AS h4 FROM hashed),
placed AS (
  SELECT doc_id, text, tokens, len(tokens) AS n, h1 % (len(tokens) + 1) AS x, h2 % (len(tokens) + 1) AS y,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50
      THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM cutup),
parts AS (
  SELECT doc_id, text, n, form, array_to_string(tokens[1:least(x, y)], '') AS a,
    array_to_string(tokens[least(x, y) + 1:greatest(x, y)], '') AS b,
    array_to_string(tokens[greatest(x, y) + 1:], '') AS c FROM placed)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(a)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(b)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b
         ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
