"""Registered queries: duplicates, reconciliation, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from hemicycle.operators import quality as qo
from hemicycle.operators import sentiment as se
from hemicycle.plans import mapping as m
from hemicycle.plans.registry import Tables, query, rounded
from hemicycle.schemas import CLASSES
from hemicycle.session import scratch_path

query("duplicates_by_key", """
    SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1
""")(lambda t: qo.duplicates_by_long_key(t.texts, ["text"], "doc_id"))

query("duplicates_by_short_key", """
    SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL HAVING count(*) > 1
""")(lambda t: qo.duplicates_by_key(t.conversations, ["conv_id", "role"]))

query("duplicate_totals", """
    SELECT CAST(sum(n) AS BIGINT) AS entries, count(*) AS unique_keys, count(*) FILTER (WHERE n > 1) AS duplicated_keys,
           CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS entries_in_duplicates
    FROM (SELECT text, count(*) AS n FROM documents GROUP BY text)
""")(lambda t: qo.duplicate_totals(t.texts, ["text"]))

query("duplicates_kind", """
    SELECT count(*) FILTER (WHERE k = 1) AS identical, count(*) FILTER (WHERE k > 1) AS different FROM (
        SELECT text, count(*) AS n, count(DISTINCT (source, lang)) AS k FROM documents GROUP BY text) WHERE n > 1
""")(lambda t: qo.duplicates_kind(t.documents, ["text"], ["source", "lang"]))

query("duplicate_diff_fields", """
    WITH lagged AS (
        SELECT *, lag(doc_id) OVER w AS pd, lag(source) OVER w AS ps, lag(lang) OVER w AS pl, lag(n_chars) OVER w AS pn
        FROM documents WINDOW w AS (PARTITION BY text ORDER BY doc_id))
    SELECT doc_id, concat_ws(', ', CASE WHEN source IS DISTINCT FROM ps THEN 'source' END,
               CASE WHEN lang IS DISTINCT FROM pl THEN 'lang' END,
               CASE WHEN n_chars IS DISTINCT FROM pn THEN 'n_chars' END) AS differences,
           source IS NOT DISTINCT FROM ps AND lang IS NOT DISTINCT FROM pl AND n_chars IS NOT DISTINCT FROM pn AS identical
    FROM lagged WHERE pd IS NOT NULL
""")(lambda t: qo.duplicate_diff_fields(t.documents, ["text"], "doc_id", ["source", "lang", "n_chars"]))

query("top_duplicates", """
    SELECT min(doc_id) AS doc_id, text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1
    ORDER BY n DESC, min(doc_id) LIMIT 20
""")(lambda t: qo.top_duplicates(t.documents, ["text"], "doc_id"))


def _ids(t: Tables):
    # every label twice on the right side for toxic documents, so that both sides have repeats
    left = t.documents.select(F.floor(F.col("doc_id") / F.lit(2)).alias("id"))
    right = t.labels.select(F.col("doc_id").alias("id")).unionByName(
        t.labels.where("toxic = 1").select(F.col("doc_id").alias("id"))
    )
    return left, right


_IDS = """
    l AS (SELECT doc_id // 2 AS id, count(*) AS n FROM documents GROUP BY 1),
    r AS (SELECT id, count(*) AS n FROM (SELECT doc_id AS id FROM labels
          UNION ALL SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1),
    j AS (SELECT coalesce(l.id, r.id) AS id, coalesce(l.n, 0) AS a, coalesce(r.n, 0) AS b
          FROM l FULL JOIN r ON l.id = r.id)"""

query("reconcile_ids", f"""
    WITH {_IDS}
    SELECT CAST(sum(a) AS BIGINT) AS total_left, CAST(sum(b) AS BIGINT) AS total_right,
           count(*) FILTER (WHERE a > 0) AS unique_left, count(*) FILTER (WHERE b > 0) AS unique_right,
           count(*) FILTER (WHERE a > 0 AND b > 0) AS common, count(*) FILTER (WHERE b = 0) AS missing,
           count(*) FILTER (WHERE a = 0) AS extra, count(*) FILTER (WHERE a > 1) AS duplicates_left,
           count(*) FILTER (WHERE b > 1) AS duplicates_right,
           round(100.0::DOUBLE * count(*) FILTER (WHERE a > 0 AND b > 0) / count(*) FILTER (WHERE a > 0), 6) AS match_rate
    FROM j
""")(lambda t: rounded(qo.reconcile_ids(*_ids(t), "id"), "match_rate"))

query("reconcile_detail", f"""
    WITH {_IDS}
    SELECT id, 'missing' AS finding, a AS n FROM j WHERE b = 0
    UNION ALL SELECT id, 'extra', b FROM j WHERE a = 0
    UNION ALL SELECT id, 'duplicate_left', a FROM j WHERE a > 1
    UNION ALL SELECT id, 'duplicate_right', b FROM j WHERE b > 1
""")(lambda t: qo.reconcile_detail(*_ids(t), "id"))


# checks


def _sql_check(name: str, value: str, threshold: str, passed: str, source: str) -> str:
    return f"""
    SELECT '{name}' AS "check", CAST(v AS DOUBLE) AS value, CAST({threshold} AS DOUBLE) AS threshold,
           ({passed}) AS passed FROM (SELECT {value} AS v, count(*) AS n FROM {source})"""


_DATED = "(SELECT l.doc_id, o.o_orderdate AS d FROM labels l LEFT JOIN orders o ON l.doc_id * 7 = o.o_orderkey)"


def _half_dated(t: Tables):
    return t.labels.join(
        t.orders.select(F.col("o_orderkey").alias("_k"), F.col("o_orderdate").alias("d")),
        F.col("doc_id") * 7 == F.col("_k"), "left",
    ).select("doc_id", "d")


_CHECKS = {
    # one of the seven fields is filled nowhere, one only for one language
    "dq_required_fields": (
        f"WITH {m.SQL_INTERVENTIONS}" + _sql_check(
            "required_fields", "(count(date_seance) = 0)::INT + (count(texte) = 0)::INT + (count(section_id) = 0)::INT "
            "+ (count(para_id) = 0)::INT + (count(NULL) = 0)::INT + (count(CASE WHEN section_id = 'fr' THEN 1 END) = 0)::INT "
            "+ (count(orateur_nom) = 0)::INT", "0", "v <= 0", "interventions"),
        lambda t: qo.dq_required_fields(m.interventions(t).withColumns({
            "legislature": F.lit(None).cast("int"), "publication_numero": F.when(F.col("section_id") == "fr", 1)})),
    ),
    "dq_core_fields": (
        _sql_check("core_fields", "count(*) FILTER (WHERE d IS NULL OR doc_id IS NULL)", "0", "v <= 0", _DATED),
        lambda t: qo.dq_core_fields(_half_dated(t), ["doc_id", "d"]),
    ),
    "dq_no_empty_text": (
        _sql_check("no_empty_text", "count(*) FILTER (WHERE trim(text) = '' OR text IS NULL)", "0", "v <= 0", "documents"),
        lambda t: qo.dq_no_empty_text(t.documents, "text"),
    ),
    "dq_dates_valid": (
        _sql_check("dates_valid", "count(*) FILTER (WHERE event_type = 'error')", "0", "v <= 0", "events"),
        lambda t: qo.dq_dates_valid(t.events.select(F.when(
            F.col("event_type") == "error", F.lit("2024-02-31")
        ).otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("d")), "d"),
    ),
    "dq_names_nonempty": (
        _sql_check("names_nonempty", "count(*) FILTER (WHERE c_name = '')", "0", "v <= 0", "customer"),
        lambda t: qo.dq_names_nonempty(t.customer, "c_name"),
    ),
    "dq_short_texts": (
        _sql_check("short_texts", "count(*) FILTER (WHERE length(text) < 10)", "floor(0.05 * n)", "v <= floor(0.05 * n)", "documents"),
        lambda t: qo.dq_short_texts(t.documents, "text"),
    ),
    "dq_min_rows": (
        _sql_check("min_rows", "count(*)", "100", "v >= 100", "documents"),
        lambda t: qo.dq_min_rows(t.documents),
    ),
    "dq_min_speakers": (
        _sql_check("min_speakers", "count(DISTINCT source)", "10", "v >= 10", "documents"),
        lambda t: qo.dq_min_speakers(t.documents, "source"),
    ),
    "dq_avg_length": (
        _sql_check("avg_length", "round(avg(length(text)), 6)", "5000", "v BETWEEN 50 AND 5000", "documents"),
        lambda t: rounded(qo.dq_avg_length(t.documents, "text"), "value"),
    ),
    "dq_count_tolerance": (
        _sql_check("count_tolerance", "abs(count(*) - (SELECT count(*) FROM labels))", "greatest(1, floor(0.05 * n))",
                   "v <= greatest(1, floor(0.05 * n))", "documents"),
        lambda t: qo.dq_count_tolerance(t.documents, t.labels),
    ),
    "dq_ids_exist": (
        _sql_check("ids_exist", "count(*)", "0", "v <= 0",
                   "(SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)"),
        lambda t: qo.dq_ids_exist(t.documents, t.labels, "doc_id"),
    ),
    "dq_metadata_exist": (
        _sql_check("metadata_exist", "count(*)", "0", "v <= 0",
                   "(SELECT source FROM documents EXCEPT SELECT source FROM documents WHERE lang = 'en')"),
        lambda t: qo.dq_metadata_exist(t.documents, t.documents.where("lang = 'en'"), "source"),
    ),
    "dq_text_equal": (
        _sql_check("text_equal", f"count(*) FILTER (WHERE {m.sql_clean('text')} <> {m.sql_clean('b')})", "0", "v <= 0",
                   "(SELECT text, CASE WHEN lang = 'fr' THEN replace(text, ' ', '') "
                   "ELSE replace(text, ' ', chr(9) || ' ') END AS b FROM documents)"),
        lambda t: qo.dq_text_equal(t.texts, t.documents.withColumn("text", F.when(
            F.col("lang") == "fr", F.replace("text", F.lit(" "), F.lit(""))
        ).otherwise(F.replace("text", F.lit(" "), F.lit("\t ")))), "doc_id", "text"),
    ),
}
for _name, (_sql, _build) in _CHECKS.items():
    query(_name, _sql)(_build)

# all thirteen checks of documents against the documents that have a label, in one pass
_CHECKED = qo.Checked(key="doc_id", text="text", date_text="day", speaker="source", metadata="lang",
                      core=("doc_id", "text", "day"), required=("doc_id", "text", "source", "lang", "day", "never", "nowhere"))


def _loaded(t: Tables):
    """A table with some odd dates and a field that is never filled; texts of one language differ."""
    return t.documents.select(
        "doc_id", "lang", F.when(F.col("doc_id") % 50 != 7, F.col("source")).otherwise("").alias("source"),
        F.when(F.col("lang") == "fr", F.concat(F.col("text"), F.lit(" fin"))).otherwise(F.col("text")).alias("text"),
        F.when(F.col("doc_id") % 40 == 3, "2024-02-31").otherwise("2024-02-01").alias("day"),
        F.lit(None).cast("string").alias("never"),
    ).where("doc_id % 30 <> 11")


_LOADED = """
    loaded AS (
        SELECT doc_id, lang, CASE WHEN doc_id % 50 <> 7 THEN source ELSE '' END AS source,
               CASE WHEN lang = 'fr' THEN text || ' fin' ELSE text END AS text,
               CASE WHEN doc_id % 40 = 3 THEN '2024-02-31' ELSE '2024-02-01' END AS day
        FROM documents WHERE doc_id % 30 <> 11)"""
_ROW_CHECKS = [
    ("required_fields", "2", "0", "v <= 0"),
    ("core_fields", "count(*) FILTER (WHERE doc_id IS NULL OR text IS NULL OR day IS NULL)", "0", "v <= 0"),
    ("no_empty_text", "count(*) FILTER (WHERE trim(text) = '' OR text IS NULL)", "0", "v <= 0"),
    ("dates_valid", "count(*) FILTER (WHERE day IS NOT NULL AND try_cast(day AS DATE) IS NULL)", "0", "v <= 0"),
    ("names_nonempty", "count(*) FILTER (WHERE source = '')", "0", "v <= 0"),
    ("short_texts", "count(*) FILTER (WHERE length(text) < 10)", "floor(0.05 * n)", "v <= floor(0.05 * n)"),
    ("min_rows", "count(*)", "100", "v >= 100"),
    ("min_speakers", "count(DISTINCT source)", "10", "v >= 10"),
    ("avg_length", "round(avg(length(text)), 6)", "5000", "v BETWEEN 50 AND 5000"),
]
_SQL_ROW_CHECKS = " UNION ALL ".join(_sql_check(n, v, t, p, "loaded") for n, v, t, p in _ROW_CHECKS)
query("quality_report", f"""
    WITH {_LOADED} {_SQL_ROW_CHECKS}
    UNION ALL {_sql_check("count_tolerance", "abs(count(*) - (SELECT count(*) FROM loaded))", "greatest(1, floor(0.05 * n))",
                          "v <= greatest(1, floor(0.05 * n))", "documents")}
    UNION ALL {_sql_check("ids_exist", "count(*)", "0", "v <= 0", "(SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM loaded)")}
    UNION ALL {_sql_check("metadata_exist", "count(*)", "0", "v <= 0", "(SELECT lang FROM documents EXCEPT SELECT lang FROM loaded)")}
    UNION ALL {_sql_check("text_equal", f"count(*) FILTER (WHERE {m.sql_clean('a.text')} <> {m.sql_clean('b.text')})", "0", "v <= 0",
                          "documents a JOIN loaded b USING (doc_id)")}
""")(lambda t: rounded(qo.full_report(_loaded(t), t.documents, _CHECKED), "value"))


def _watched(t: Tables):
    """The checks over rows of a table that is written, taken from the write itself."""
    watch = qo.Watch(_CHECKED)
    watch.over(_loaded(t)).write.parquet(scratch_path(t.spark, "watched"))
    return watch.report()


query("quality_of_write", f"WITH {_LOADED} {_SQL_ROW_CHECKS}")(lambda t: rounded(_watched(t), "value"))


def _pairs(t: Tables):
    """Every document without and with a favourable opening."""
    return t.texts.select(
        F.col("text").alias("low"), F.concat(F.lit("Bravo, remarquable. "), F.col("text")).alias("high")
    )


def _phrases(t: Tables):
    """Documents as reference phrases: their language is the class."""
    kind = {"fr": "very_positive", "de": "very_negative", "en": "positive"}
    label = F.coalesce(*[F.when(F.col("lang") == k, F.lit(v)) for k, v in kind.items()], F.lit("neutral"))
    return t.texts.select(label.alias("label"), "text")


# class probabilities of a text, written out
def _sql_index(text: str) -> str:
    hits = {c: f"len(list_filter({m.sql_tokens(text)}, lambda x: x IN ({', '.join(repr(w) for w in words)})))"
            for c, words in WORDS.items()}
    scale = f"6.0::DOUBLE / sqrt(greatest(len({m.sql_tokens(text)}), 1)::DOUBLE)"
    logit = {c: f"exp({hits[c]} * {scale})" if c in hits else "exp(1.0::DOUBLE)" for c in CLASSES}
    return "round((" + " + ".join(f"{i} * {logit[c]}" for i, c in enumerate(CLASSES)) + ") / (" + " + ".join(logit.values()) + "), 9)"


WORDS = {"very_negative": ("der", "die", "von"), "negative": ("und", "den"), "positive": ("the", "of", "and"),
         "very_positive": ("la", "de", "que", "bravo", "remarquable")}


def _index(df, text):
    # rounded on both sides: sums of the same terms may differ in their last bits
    return se.sentiment_index(df, text, WORDS).withColumn("score", F.round("score", 9))


query("dq_score_order", f"""
    WITH scored AS (SELECT {_sql_index("text")} AS low, {_sql_index("('Bravo, remarquable. ' || text)")} AS high FROM documents)
    {_sql_check("score_order", "(count(*) FILTER (WHERE low < high))::DOUBLE / count(*)", "0.75", "v >= 0.75", "scored")}
""")(lambda t: qo.dq_score_order(_pairs(t), _index))

query("dq_score_rules", f"""
    WITH scored AS (SELECT lang, {_sql_index("text")} AS score FROM documents),
    means AS (SELECT avg(score) FILTER (WHERE lang = 'de') AS low, avg(score) FILTER (WHERE lang = 'fr') AS high,
                     avg(score) FILTER (WHERE lang NOT IN ('de', 'fr', 'en')) AS mid FROM scored)
    SELECT 'score_extremes' AS "check", round(high - low, 6) AS value, 0.0::DOUBLE AS threshold, high > low AS passed FROM means
    UNION ALL SELECT 'score_neutral', round(mid, 6), 3.0, mid BETWEEN 1 AND 3 FROM means
    UNION ALL SELECT 'score_sums', 0.0, 0.0, count(*) > 0 FROM scored
""")(lambda t: rounded(qo.dq_score_references(_phrases(t), _index).unionByName(
    qo.dq_score_sums(se.score_sentiment(t.texts.select("text"), "text", WORDS), CLASSES)), "value").withColumn(
    "threshold", F.round("threshold", 4)))
