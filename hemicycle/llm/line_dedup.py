"""Line dedup over overlapping windows of three consecutive lines.

A text is cut at line feeds. Every three consecutive lines form a window, known by 128 bits
of hash. The first occurrence of a window, in order of (doc_id, position), stays; each later
one covers its three lines, and covered lines are removed. Overlapping occurrences merge,
since a line is removed once.

Counting windows and finding the first occurrence are partial aggregations, so a window
that a third of all documents share sends one row per task. Only windows that occur again
are joined back (on the hash; Spark splits a hot one), and only covered positions travel to
their documents.

Defined cases: texts of fewer than three lines have no window and stay as they are; a null
text stays null with no lines; rows without doc_id come last in the order; rows with equal
doc_id and text are one document and get the same result; a text all of whose lines are
covered becomes empty; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 3
#: Order of a row without doc_id.
LAST = (1 << 63) - 1
ROW_ID, ROW_HASH = "__row_id", "__row_hash"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def window_hashes(lines: Column) -> Column:
    """array<struct<pos, a, b>>: position and 128 bits of each three-line window."""
    one = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("|"), x).alias("b")))

    def window(hashes: Column, at: Column) -> Column:
        part = [F.get(hashes, at + i) for i in range(WINDOW)]
        return F.struct(
            at.alias("pos"),
            F.xxhash64(*[p["a"] for p in part]).alias("a"),
            F.xxhash64(*[p["b"] for p in part]).alias("b"),
        )

    places = F.sequence(F.lit(0), F.size(lines) - WINDOW)
    # the hashes are bound once: a lambda over a one-element array
    return F.flatten(F.transform(F.array(one), lambda h: F.transform(places, lambda at: window(h, at))))


def keyed(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Identity of a document that holds across scans: its id and the hash of its text."""
    return documents.select(
        "*",
        F.coalesce(F.col(f"`{id_column}`").cast("long"), F.lit(LAST)).alias(ROW_ID),
        F.coalesce(F.xxhash64(F.col(f"`{text_column}`")), F.lit(0)).alias(ROW_HASH),
    )


def later_windows(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(row id, row hash, covered): sorted positions of lines that later occurrences cover."""
    text = F.col(f"`{text_column}`")
    windows = (
        keyed(documents, id_column, text_column)
        .where(F.size(lines_of(text)) >= WINDOW)
        .select(ROW_ID, ROW_HASH, F.explode(window_hashes(lines_of(text))).alias("w"))
        .select(ROW_ID, ROW_HASH, "w.pos", "w.a", "w.b")
    )
    place = F.struct(ROW_ID, ROW_HASH, "pos")
    firsts = (
        windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where(F.col("first") != F.col("last")).drop("last")
    )
    later = windows.join(firsts, ["a", "b"]).where(place != F.col("first"))
    covered = F.array_distinct(F.flatten(F.transform(
        F.collect_set("pos"), lambda p: F.array(*[p + i for i in range(WINDOW)]))))
    return later.groupBy(ROW_ID, ROW_HASH).agg(covered.alias("__covered"))


def dedup_lines(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents with ``text`` rewritten, and ``n_lines``, ``n_removed`` beside them."""
    text = F.col(f"`{text_column}`")
    rows = keyed(documents, id_column, text_column)
    joined = rows.join(later_windows(documents, id_column, text_column), [ROW_ID, ROW_HASH], "left")
    lines = lines_of(text)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__covered"))
    rewritten = F.array_join(F.flatten(F.transform(
        F.array(lines), lambda all_lines: F.transform(kept, lambda i: F.get(all_lines, i)))), "\n")
    removed = F.coalesce(F.size("__covered"), F.lit(0))
    own = [c for c in documents.columns if c not in ("n_lines", "n_removed")]
    return joined.withColumns({
        "n_lines": F.when(text.isNull(), 0).otherwise(F.size(lines)),
        "n_removed": F.when(F.col("__covered").isNull(), 0).otherwise(removed),
    }).select(
        *[F.when(F.col("__covered").isNull(), text).otherwise(rewritten).alias(text_column)
          if c == text_column else F.col(f"`{c}`") for c in own],
        "n_lines", "n_removed",
    )


SQL = """
WITH lines AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
windows AS (
  SELECT doc_id, text, pos, lines[pos + 1] AS a, lines[pos + 2] AS b, lines[pos + 3] AS c
  FROM (SELECT DISTINCT doc_id, text, lines, unnest(range(0, len(lines) - 2)) AS pos FROM lines)),
ranked AS (
  SELECT doc_id, text, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id NULLS LAST, pos) AS n
  FROM windows),
covered AS (
  SELECT DISTINCT doc_id, text, unnest([pos, pos + 1, pos + 2]) AS pos FROM ranked WHERE n > 1),
removed AS (SELECT doc_id, text, list(pos) AS gone FROM covered GROUP BY doc_id, text)
SELECT l.doc_id,
  CASE WHEN r.gone IS NULL THEN l.text ELSE array_to_string(
    list_transform(list_filter(range(0, len(l.lines)), lambda i: NOT list_contains(r.gone, i)),
                   lambda i: l.lines[i + 1]), chr(10)) END AS text,
  coalesce(len(l.lines), 0)::INTEGER AS n_lines, coalesce(len(r.gone), 0)::INTEGER AS n_removed
FROM lines l LEFT JOIN removed r ON l.doc_id IS NOT DISTINCT FROM r.doc_id AND l.text IS NOT DISTINCT FROM r.text
"""
