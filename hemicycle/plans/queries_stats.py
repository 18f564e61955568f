"""Registered queries: aggregates, windows, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from hemicycle.functions import dates as dt
from hemicycle.functions import files as fl
from hemicycle.functions import french
from hemicycle.functions import scores as sc
from hemicycle.functions import text as tx
from hemicycle.operators import aggregates as ag
from hemicycle.operators import filters as fo
from hemicycle.operators import joins as jo
from hemicycle.operators import ordering, search
from hemicycle.plans import mapping as m
from hemicycle.plans.registry import Tables, query, r6, rounded
from hemicycle.schemas import CLASSES
from hemicycle.session import scratch_path
from hemicycle.sources import sketches

# counts

query("count_all", "SELECT count(*) AS n FROM documents")(lambda t: ag.count_all(t.documents))

_YEARS = "SELECT CAST(year(o_orderdate) AS INTEGER) AS annee, count(*) AS n FROM orders GROUP BY 1"


def _order_years(t: Tables):
    return t.orders.select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("date_seance"),
        F.year("o_orderdate").alias("annee"),
    )


query("count_by_year", _YEARS)(lambda t: ag.count_by_year(_order_years(t)))

query("count_by_month", """
    SELECT CAST(month(o_orderdate) AS INTEGER) AS mois, count(*) AS n FROM orders GROUP BY 1
""")(lambda t: ag.count_by_month(_order_years(t), "date_seance"))

query("stats_by_year", f"""
    WITH {m.SQL_INTERVENTIONS}
    SELECT annee, count(*) AS documents, count(DISTINCT texte) AS distinct_keys
    FROM interventions GROUP BY annee
""")(lambda t: ag.stats_by_year(
    # texts are counted by digest: 32 bytes each are shuffled instead of the texts
    m.dated(t, t.texts.select(
        F.col("doc_id").alias("para_id"), tx.digest(F.col("text")).alias("key")
    )), F.col("key"),
))

query("stats_by_year_approx")(lambda t: ag.stats_by_year(
    m.dated(t, t.texts.select(F.col("doc_id").alias("para_id"), F.xxhash64("text").alias("key"))),
    F.col("key"), approximate=True,
))



def _within(estimate, exact):
    """The exact count where the estimate is within five per cent of it, else the estimate."""
    return F.when(F.abs(estimate - exact) <= 0.05 * exact, exact).otherwise(estimate)


def _stored_years(t: Tables):
    """Two loads, each read once, counted into one stored table."""
    rows = m.dated(t, t.documents.select(F.col("doc_id").alias("para_id"), F.xxhash64("text").alias("key"), "source"))
    path = scratch_path(t.spark, "sketches")
    for load, lang in (("english", F.col("lang") == "en"), ("others", F.col("lang") != "en")):
        part = t.documents.where(lang).select(F.col("doc_id").alias("para_id"))
        sketches.add_load(rows.join(part, "para_id", "left_semi"), path, load, F.col("key"))
    return rows, path


def _sketched_years(t: Tables):
    rows, path = _stored_years(t)
    exact = rows.groupBy("annee").agg(F.count_distinct("key").alias("exact"))
    return sketches.stored_by_year(t.spark, path).join(exact, "annee").select(
        "annee", "documents", _within(F.col("distinct_keys"), F.col("exact")).alias("distinct_keys"))


query("stats_by_year_sketches", f"""
    WITH {m.SQL_INTERVENTIONS}
    SELECT annee, count(*) AS documents, count(DISTINCT texte) AS distinct_keys
    FROM interventions GROUP BY annee
""")(_sketched_years)


def _sketched_total(t: Tables):
    rows, path = _stored_years(t)
    exact = rows.agg(F.count_distinct("key")).scalar()
    return sketches.stored_total(t.spark, path).select(
        "documents", _within(F.col("distinct_keys"), exact).alias("distinct_keys"))


query("distinct_keys_sketches", f"""
    WITH {m.SQL_INTERVENTIONS} SELECT count(*) AS documents, count(DISTINCT texte) AS distinct_keys FROM interventions
""")(_sketched_total)

query("word_count_by_date", f"""
    WITH {m.SQL_INTERVENTIONS}
    SELECT date_seance, CAST(sum(len(string_split(texte, ' '))) AS BIGINT) AS words FROM interventions GROUP BY 1
""")(lambda t: ag.word_count_by_date(
    m.dated(t, ag.counted_words(t.texts.select(F.col("doc_id").alias("para_id"), "text"), "text")), "text", "date_seance"))

query("corpus_word_stats", f"""
    SELECT total_words, total_docs, docs_without_text,
           round(total_words / (total_docs - docs_without_text), 6) AS mean_words
    FROM (SELECT CAST(sum({m.sql_words("coalesce(x, '')")}) AS BIGINT) AS total_words, count(*) AS total_docs,
                 count(*) FILTER (WHERE x IS NULL OR x = '') AS docs_without_text
          FROM (SELECT CASE WHEN doc_id % 10 = 0 THEN NULL ELSE text END AS x FROM documents))
""")(lambda t: rounded(ag.corpus_word_stats(
    t.texts.select(F.when(F.col("doc_id") % 10 != 0, F.col("text")).alias("x")), "x"
), "mean_words"))

query("value_counts", """
    SELECT event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1
""")(lambda t: ag.value_counts(t.events, "event_type"))

query("date_span", "SELECT min(ts) AS first_date, max(ts) AS last_date FROM events")(
    lambda t: ag.date_span(t.events, "ts")
)

query("describe_length", """
    SELECT count(*) AS "count", round(avg(length(text)), 6) AS mean,
           round(stddev_samp(length(text)), 6) AS std, min(length(text)) AS min,
           round(quantile_cont(length(text), 0.25), 6) AS p25,
           round(quantile_cont(length(text), 0.5), 6) AS p50,
           round(quantile_cont(length(text), 0.75), 6) AS p75, max(length(text)) AS max
    FROM documents
""")(lambda t: rounded(
    ag.describe_length(t.documents, "text"), "mean", "std", "p25", "p50", "p75"
))

query("median_length", "SELECT median(length(text)) AS median_length FROM documents")(
    lambda t: ag.median_length(t.documents, "text")
)

query("avg_length", "SELECT round(avg(length(text)), 6) AS avg_length FROM documents")(
    lambda t: rounded(ag.avg_length(t.documents, "text"), "avg_length")
)

query("histogram_length", """
    WITH b AS (SELECT min(length(text))::DOUBLE AS lo, max(length(text))::DOUBLE AS hi FROM documents),
    filled AS (
        SELECT CAST(least(floor((length(text) - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS bin, count(*) AS n
        FROM documents, b GROUP BY 1)
    SELECT CAST(r.range AS INTEGER) AS bin, coalesce(n, 0) AS n
    FROM range(50) r LEFT JOIN filled ON filled.bin = r.range
""")(lambda t: ag.histogram_length(t.documents, "text"))

query("distinct_values", "SELECT DISTINCT c_mktsegment FROM customer")(
    lambda t: ag.distinct_values(t.customer, "c_mktsegment")
)

query("distinct_speakers", "SELECT count(DISTINCT source) AS speakers FROM documents")(
    lambda t: ag.distinct_speakers(t.documents, "source")
)
query("distinct_speakers_approx")(
    lambda t: ag.distinct_speakers(t.documents, "source", approximate=True)
)

_STOP = ", ".join(f"'{w}'" for w in french.STOP_WORDS)
query("word_frequencies", f"""
    SELECT word, count(*) AS n FROM (SELECT unnest({m.sql_tokens()}) AS word FROM documents)
    WHERE word NOT IN ({_STOP}) GROUP BY word ORDER BY n DESC, word LIMIT 100
""")(lambda t: ag.word_frequencies(t.texts, "text", french.STOP_WORDS))

query("run_statistics", f"""
    WITH {m.SQL_FILE_STATS},
    s AS (SELECT count(*) AS total, count(*) FILTER (WHERE status = 'success') AS success,
                 count(*) FILTER (WHERE status = 'failed') AS failed,
                 count(*) FILTER (WHERE status = 'skipped') AS skipped,
                 CAST(sum(documents_count) FILTER (WHERE status = 'success') AS BIGINT) AS documents_indexed,
                 sum(duration_seconds) AS seconds
          FROM file_stats)
    SELECT total, success, failed, skipped, documents_indexed,
           round(seconds, 6) AS duration_seconds, round(100.0::DOUBLE * success / total, 6) AS success_pct,
           round(100.0::DOUBLE * failed / total, 6) AS failed_pct,
           round(100.0::DOUBLE * skipped / total, 6) AS skipped_pct,
           round(seconds / success, 6) AS seconds_per_success
    FROM s
""")(lambda t: rounded(
    ag.run_statistics(m.file_stats(t)),
    "duration_seconds", "success_pct", "failed_pct", "skipped_pct", "seconds_per_success",
))

query("import_report", f"""
    WITH {m.SQL_FILE_STATS},
    totals AS (
        SELECT count(*) AS total_files, count(*) FILTER (WHERE status = 'success') AS success_files,
               count(*) FILTER (WHERE status = 'failed') AS failed_files,
               count(*) FILTER (WHERE status = 'skipped') AS skipped_files,
               CAST(sum(documents_count) FILTER (WHERE status = 'success') AS BIGINT) AS total_documents
        FROM file_stats),
    years AS (
        SELECT CAST(year AS VARCHAR) AS year, CAST(sum(documents_count) AS BIGINT) AS documents
        FROM file_stats WHERE status = 'success' GROUP BY 1)
    SELECT * FROM totals CROSS JOIN years
""")(lambda t: ag.import_report(m.file_stats(t)).select(
    "total_files", "success_files", "failed_files", "skipped_files", "total_documents",
    F.explode("documents_by_year").alias("year", "documents"),
))

query("count_by_doc_type", """
    SELECT event_type, count(*) AS n,
           round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM events), 6) AS ratio_pct
    FROM events GROUP BY 1
""")(lambda t: rounded(ag.count_by_doc_type(t.events, "event_type"), "ratio_pct"))

query("column_info", """
    WITH c AS (SELECT count(*) AS n_rows, count(doc_id) AS a, count(lang) AS b, count(quality) AS q
               FROM (SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)))
    SELECT 0 AS "position", 'doc_id' AS column_name, 'bigint' AS data_type, a AS non_null, n_rows, 3 AS n_columns FROM c
    UNION ALL SELECT 1, 'lang', 'string', b, n_rows, 3 FROM c
    UNION ALL SELECT 2, 'quality', 'int', q, n_rows, 3 FROM c
""")(lambda t: ag.column_info(
    t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
))

query("table_status", f"""
    SELECT annee, n, (SELECT count(*) FROM orders) AS documents FROM ({_YEARS})
""")(lambda t: ag.table_status(_order_years(t)).select(
    "documents", F.explode("documents_by_year").alias("annee", "n")
))


# sentiment series

_S = f"WITH {m.SQL_SENTIMENTS}"

query("sentiment_daily", f"""
    {_S} SELECT date_seance, round(avg({m.SQL_SCORE}), 6) AS mean,
                round(stddev_samp({m.SQL_SCORE}), 6) AS std, count(*) AS "count"
    FROM sentiments GROUP BY 1
""")(lambda t: rounded(
    ag.sentiment_daily(m.sentiments(t), "date_seance", sc.sentiment_score()), "mean", "std"
))
query("sentiment_daily_group", f"""
    {_S} SELECT date_seance, groupe_politique, round(avg({m.SQL_SCORE}), 6) AS mean, count(*) AS "count"
    FROM sentiments GROUP BY 1, 2
""")(lambda t: rounded(ag.sentiment_daily_group(
    m.sentiments(t), "date_seance", "groupe_politique", sc.sentiment_score()
), "mean"))
query("sentiment_daily_group_min", f"""
    {_S} SELECT date_seance, groupe_politique, round(min({m.SQL_SCORE}), 6) AS min, count(*) AS "count"
    FROM sentiments GROUP BY 1, 2
""")(lambda t: rounded(ag.sentiment_daily_group_min(
    m.sentiments(t), "date_seance", "groupe_politique", sc.sentiment_score()
), "min"))
query("sentiment_monthly", f"""
    {_S} SELECT CAST(date_trunc('month', date_seance) AS DATE) AS periode,
        {", ".join(f"round(avg({c}), 6) AS {c}" for c in CLASSES)}
    FROM sentiments GROUP BY 1
""")(lambda t: rounded(ag.sentiment_monthly(m.sentiments(t), "date_seance", CLASSES), *CLASSES))
query("sentiment_global_mean", f"{_S} SELECT round(avg({m.SQL_SCORE}), 6) AS mean FROM sentiments")(
    lambda t: rounded(ag.sentiment_global_mean(m.sentiments(t), sc.sentiment_score()), "mean")
)
query("sentiment_score", f"{_S} SELECT para_id, round({m.SQL_SCORE}, 6) AS score FROM sentiments")(
    lambda t: m.sentiments(t).select("para_id", r6(sc.sentiment_score()).alias("score"))
)
query("sentiment_index_0_4", f"""
    {_S} SELECT para_id, round(negative + 2.0 * neutral + 3.0 * positive + 4.0 * very_positive, 6) AS idx
    FROM sentiments
""")(lambda t: m.sentiments(t).select("para_id", r6(sc.sentiment_index_0_4()).alias("idx")))


# runs and windows



def _hour():
    return F.date_trunc("hour", F.col("ts"))


_RUNS = """
    flagged AS (
        SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS f
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    runs AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM flagged)"""

query("para_runs", f"""
    WITH {_RUNS}
    SELECT event_id, user_id, event_type, min(ts) OVER (PARTITION BY user_id, run) AS run_start FROM runs
""")(lambda t: ordering.para_runs(
    t.events.select("event_id", "user_id", "event_type", "ts"), ["user_id"], ["ts"], "event_type", _hour()
).select("event_id", "user_id", "event_type", F.col("run_start.ts").alias("run_start")))

query("merge_same_para", f"""
    WITH {_RUNS}
    SELECT user_id, event_type, min(ts) AS run_start, min_by(event_id, ts) AS event_id,
           string_agg(props, ' ' ORDER BY ts) AS texte, count(*) AS merged_rows
    FROM runs GROUP BY user_id, event_type, run
""")(lambda t: ordering.merge_same_para(
    t.events.select("event_id", "user_id", "event_type", "ts", F.col("props").alias("texte")),
    ["user_id"], ["ts"], "event_type", "texte", _hour(), ["event_id"],
).withColumn("run_start", F.col("run_start.ts")))

query("latest_per_key", """
    SELECT o_custkey, o_orderkey, o_totalprice FROM (
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn
        FROM orders) WHERE rn = 1
""")(lambda t: jo.latest_per_key(
    t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")]
).select("o_custkey", "o_orderkey", "o_totalprice"))


# scalar functions

query("clean_text", f"SELECT doc_id, md5({m.sql_clean('text')}) AS cleaned FROM documents")(
    lambda t: t.texts.select("doc_id", F.md5(tx.clean_text(F.col("text"))).alias("cleaned"))
)

# turns as transcripts that start with the speaker's name, every second one indented
def _spoken():
    return F.concat(
        F.when(F.col("turn") % 2 == 0, F.lit("\n    ")).otherwise(F.lit("")), F.lit("M. "),
        F.upper("role"), F.lit(". "), F.col("text"),
    )


query("strip_speaker_prefix", r"""
    SELECT conv_id, turn, md5(regexp_replace(regexp_replace(
        regexp_replace(text, '^\s+', ''), '^(M\.|Mme|Mlle)\.?\s+[^.]+\.\s*', ''), '^\s+|\s+$', '', 'g')) AS texte
    FROM conversations
""")(lambda t: t.conversations.select(
    "conv_id", "turn",
    F.md5(tx.strip_speaker_prefix(_spoken(), F.concat(F.lit("M. "), F.col("role")))).alias("texte"),
))

query("clean_speaker", "SELECT c_custkey, c_name AS nom FROM customer")(
    lambda t: t.customer.select("c_custkey", tx.clean_speaker(F.concat(
        F.when(F.col("c_custkey") % 3 == 0, F.lit("M. ")).when(F.col("c_custkey") % 3 == 1, F.lit(" Mme "))
        .otherwise(F.lit("")),
        F.col("c_name"), F.when(F.col("c_custkey") % 2 == 0, F.lit(" .,. ")).otherwise(F.lit("")),
    )).alias("nom"))
)

_OPENINGS = (
    None, "M. le Président de ", "Mme la présidente et ministre ", "M. le MINISTRE ",
    "Mme la secrétaire d’État ", "M. ", "Mme ",
)
query("classify_role", """
    SELECT p_partkey, CASE
        WHEN p_partkey % 7 = 0 THEN NULL
        WHEN p_partkey % 7 IN (1, 2) THEN 'Président' WHEN p_partkey % 7 = 3 THEN 'Ministre'
        WHEN p_partkey % 7 = 4 THEN 'Secrétaire' ELSE 'Député' END AS fonction
    FROM part
""")(lambda t: t.part.select("p_partkey", tx.classify_role(F.concat(
    F.element_at(F.array(*[F.lit(x) for x in _OPENINGS]), (F.col("p_partkey") % 7 + 1).cast("int")),
    F.col("p_name"),
)).alias("fonction")))

query("tokenize", f"""
    SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({m.sql_tokens()}) AS word FROM documents)
    GROUP BY 1, 2
""")(lambda t: search.word_counts(t.texts, "doc_id", tx.tokenize(F.col("text"))))

query("word_count_ws", f"SELECT doc_id, {m.sql_words('text')} AS words FROM documents")(
    lambda t: t.texts.select("doc_id", tx.word_count_ws(F.col("text")).alias("words"))
)
query("word_count_space", "SELECT doc_id, len(string_split(text, ' ')) AS words FROM documents")(
    lambda t: t.texts.select("doc_id", tx.word_count_space(F.col("text")).alias("words"))
)
query("text_length", "SELECT doc_id, length(text) AS n FROM documents")(
    lambda t: t.documents.select("doc_id", tx.text_length(F.col("text")).alias("n"))
)
query("kwic_excerpt", """
    SELECT doc_id, '...' || substr(text, greatest(hit - 50, 0) + 1,
               least(hit + 100, length(text)) - greatest(hit - 50, 0)) || '...' AS extrait
    FROM (SELECT doc_id, text, strpos(lower(text), 'that') - 1 AS hit FROM documents) WHERE hit >= 0
""")(lambda t: t.documents.select(
    "doc_id", tx.kwic_excerpt(F.col("text"), "That").alias("extrait")
).where(F.col("extrait").isNotNull()))
query("preview", "SELECT doc_id, left(text, 80) || '...' AS debut FROM documents")(
    lambda t: t.documents.select("doc_id", tx.preview(F.col("text"), 80).alias("debut"))
)
query("full_name", """
    SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE c_mktsegment || ' ' || c_name END AS nom
    FROM customer
""")(lambda t: t.customer.select("c_custkey", tx.full_name(
    F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")), F.col("c_name")
).alias("nom")))
query("default_family", """
    SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'Non inscrit' ELSE c_mktsegment END AS famille FROM customer
""")(lambda t: t.customer.select("c_custkey", tx.default_family(
    F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment"))
).alias("famille")))
query("normalise_for_compare", f"""
    SELECT doc_id, {m.sql_clean('text')} = replace(text, chr(10), ' ') AS same FROM documents
""")(lambda t: t.texts.select("doc_id", tx.normalise_for_compare(
    F.concat(F.lit(" \t"), F.col("text"), F.lit("\n")), F.replace(F.col("text"), F.lit("\n"), F.lit("  "))
).alias("same")))
query("parse_an_date", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d FROM orders
""")(lambda t: t.orders.select("o_orderkey", dt.parse_an_date(
    F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "'Jeudi-'d'-'M'-Avril-'yyyy"))
    .when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd"))
    .otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
).alias("d")))
query("year_month", """
    SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS annee, CAST(month(o_orderdate) AS INTEGER) AS mois
    FROM orders
""")(lambda t: t.orders.select(
    "o_orderkey", dt.year_of(F.col("o_orderdate")).alias("annee"), dt.month_of(F.col("o_orderdate")).alias("mois")
))
query("to_date_coerce", """
    SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(ts AS DATE) END AS d FROM events
""")(lambda t: t.events.select("event_id", dt.to_date_coerce(
    F.when(F.col("event_type") == "error", F.lit("2024-13-45")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
).alias("d")))
query("month_period", """
    SELECT event_id, CAST(date_trunc('month', ts) AS DATE) AS periode FROM events
""")(lambda t: t.events.select("event_id", dt.month_period(F.col("ts")).alias("periode")))
query("now_timestamp", "SELECT doc_id, TRUE AS recent FROM documents")(lambda t: t.documents.select(
    "doc_id", dt.now_timestamp().alias("extraction_timestamp")
).select("doc_id", (F.abs(F.col("extraction_timestamp").cast("timestamp").cast("long") - F.unix_timestamp()) < 60).alias("recent")))
query("duration_seconds", """
    SELECT event_id,
           round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6, 6) AS seconds
    FROM events
""")(lambda t: t.events.select("event_id", r6(dt.duration_seconds(
    F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")
)).alias("seconds")))
query("percent_ratio", """
    SELECT user_id, round(100.0::DOUBLE * count(*) FILTER (WHERE event_type = 'error')
                          / nullif(count(*) FILTER (WHERE event_type = 'view'), 0), 6) AS pct
    FROM events GROUP BY user_id
""")(lambda t: t.events.groupBy("user_id").agg(r6(sc.percent_ratio(
    F.count_if(F.col("event_type") == "error"), F.count_if(F.col("event_type") == "view")
)).alias("pct")))
query("format_prob", """
    SELECT event_id, printf('%.4f', value / 1024.0 + 0.00001) AS p FROM events
""")(lambda t: t.events.select(
    "event_id", sc.format_prob(F.col("value") / F.lit(1024.0) + F.lit(0.00001)).alias("p")
))
query("file_year", f"""
    WITH {m.SQL_ARCHIVE_PATHS} SELECT page_id, {m.sql_file_year('path')} AS annee FROM archive_paths
""")(lambda t: m.archive_paths(t).select("page_id", fl.file_year(F.col("path")).alias("annee")))
query("issue_from_filename", f"""
    WITH {m.SQL_ARCHIVE_PATHS}
    SELECT page_id, TRY_CAST(substr({m.sql_stem('path')}, 4, 4) AS INTEGER) AS annee,
           TRY_CAST(regexp_extract({m.sql_stem('path')}, '^.{{7}}([0-9]+)', 1) AS INTEGER) AS numero
    FROM archive_paths
""")(lambda t: m.archive_paths(t).select(
    "page_id", fl.issue_year(F.col("path")).alias("annee"), fl.issue_number(F.col("path")).alias("numero")
))
query("manifest_by_year", f"""
    WITH {m.SQL_ARCHIVE_PATHS},
    named AS (SELECT path, {m.sql_file_year('path')} AS annee,
                     row_number() OVER (PARTITION BY {m.sql_file_year('path')} ORDER BY path) AS rn
              FROM archive_paths)
    SELECT annee, count(*) AS files, string_agg(path, ', ' ORDER BY path) FILTER (WHERE rn <= 3) AS first_files
    FROM named GROUP BY annee
""")(lambda t: ag.manifest_by_year(m.archive_paths(t), "path", fl.file_year(F.col("path"))))

query("scan_year_texts", f"""
    WITH {m.SQL_INTERVENTIONS} SELECT para_id, md5(texte) AS texte FROM interventions
    WHERE annee = 1997 AND trim(texte) <> ''
""")(lambda t: fo.scan_year_texts(m.interventions(t), 1997).select("para_id", F.md5("texte").alias("texte")))

query("french_words", rf"""
    SELECT doc_id, word, count(*) AS n FROM (
        SELECT doc_id, unnest(list_transform(
            regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}''’]+'),
            lambda w: regexp_replace(regexp_replace(w,
                '^(?:l|m|t|qu|n|s|j|d|c|jusqu|quoiqu|lorsqu|puisqu)[''’](.)', '\1'), '[''’]', '', 'g'))) AS word
        FROM documents)
    WHERE word <> '' AND word NOT IN ({_STOP}) GROUP BY 1, 2
""")(lambda t: search.word_counts(t.texts, "doc_id", french.french_words(F.col("text"))))

query("french_terms", rf"""
    WITH words AS (SELECT doc_id, word, count(*) AS n FROM (
        SELECT doc_id, unnest({m.sql_french_tokens()}) AS word FROM documents) WHERE word NOT IN ({_STOP}) GROUP BY 1, 2),
    {m.sql_stems("words")}
    SELECT doc_id, stem AS term, CAST(sum(n) AS BIGINT) AS n FROM words JOIN stems USING (word) GROUP BY 1, 2
""")(lambda t: search.term_counts(t.texts, "doc_id", "text"))
