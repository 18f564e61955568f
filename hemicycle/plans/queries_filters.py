"""Registered queries: filters, projections, joins, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from hemicycle.functions import text as tx
from hemicycle.operators import filters as fo
from hemicycle.operators import joins as jo
from hemicycle.operators import search, sets, topk
from hemicycle.plans import mapping as m
from hemicycle.plans.registry import Tables, query

query("filter_term", """
    SELECT event_id, user_id, value FROM events WHERE event_type = 'click'
""")(lambda t: fo.filter_term(t.events, "event_type", "click").select("event_id", "user_id", "value"))

query("filter_and", """
    SELECT event_id, user_id FROM events WHERE event_type = 'click' AND value > 100
""")(lambda t: fo.filter_and(
    t.events, F.col("event_type") == "click", F.col("value") > 100, None
).select("event_id", "user_id"))

query("filter_or", """
    SELECT event_id, event_type FROM events WHERE event_type = 'error' OR value > 200
""")(lambda t: fo.filter_or(
    t.events, F.col("event_type") == "error", F.col("value") > 200
).select("event_id", "event_type"))


def _labelled(t: Tables):
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")


query("filter_exists", """
    SELECT d.doc_id, l.quality FROM documents d JOIN labels l USING (doc_id)
    WHERE l.quality IS NOT NULL
""")(lambda t: fo.filter_exists(_labelled(t), "quality").select("doc_id", "quality"))

query("filter_missing", """
    SELECT d.doc_id, d.lang FROM documents d LEFT JOIN labels l USING (doc_id)
    WHERE l.quality IS NULL
""")(lambda t: fo.filter_missing(_labelled(t), "quality").select("doc_id", "lang"))


# half of the texts are made blank in turn (NULL, empty, only blanks) to give the filter work
def _blanked(t: Tables):
    turn = F.col("doc_id") % 5
    return t.documents.select(
        "doc_id",
        F.when(turn == 0, F.lit(None).cast("string")).when(turn == 1, F.lit(""))
        .when(turn == 2, F.lit(" \n\t ")).otherwise(F.col("text")).alias("x"),
    )


_SQL_BLANKED = """CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' ' || chr(10) || chr(9) || ' '
                  ELSE text END"""

query("filter_blank_text", f"""
    SELECT doc_id FROM (SELECT doc_id, {_SQL_BLANKED} AS x FROM documents)
    WHERE x IS NULL OR regexp_replace(x, '\\s+', '', 'g') = ''
""")(lambda t: fo.filter_blank_text(_blanked(t), "x").select("doc_id"))

query("filter_nonblank", f"""
    SELECT doc_id FROM (SELECT doc_id, {_SQL_BLANKED} AS x FROM documents)
    WHERE x IS NOT NULL AND regexp_replace(x, '\\s+', '', 'g') <> ''
""")(lambda t: fo.filter_nonblank(_blanked(t), "x").select("doc_id"))


# every event's props object, wrapped in a list for the larger values
def _listed(t: Tables):
    wrapped = F.concat(F.lit("["), F.col("props"), F.lit("]"))
    return t.events.select(
        "event_id", F.when(F.col("value") > 60, wrapped).otherwise(F.col("props")).alias("texte")
    )


_SQL_LISTED = "CASE WHEN value > 60 THEN '[' || props || ']' ELSE props END"

query("filter_list_text", f"""
    SELECT event_id FROM events WHERE json_type({_SQL_LISTED}) = 'ARRAY'
""")(lambda t: fo.filter_list_text(_listed(t), "texte").select("event_id"))

query("json_list_test", f"""
    SELECT event_id, json_type({_SQL_LISTED}) = 'ARRAY' AS is_list FROM events
""")(lambda t: _listed(t).select("event_id", tx.json_list_test(F.col("texte")).alias("is_list")))

query("filter_vote", "SELECT doc_id FROM labels WHERE toxic = 1")(
    lambda t: fo.filter_vote(
        t.labels.withColumn("vote_present", F.col("toxic") == 1)
    ).select("doc_id")
)

query("filter_min_length", "SELECT doc_id FROM documents WHERE length(text) > 200")(
    lambda t: fo.filter_min_length(t.documents, "text", 200).select("doc_id")
)

query("filter_group_in", "SELECT vec_id, label FROM embeddings WHERE label IN (1, 3, 7, 99)")(
    lambda t: fo.filter_group_in(t.embeddings, "label", [1, 3, 7, 99]).select("vec_id", "label")
)

query("filter_years", """
    SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS annee FROM orders
    WHERE year(o_orderdate) IN (1996, 1998, 2050)
""")(lambda t: fo.filter_years(
    t.orders.select("o_orderkey", F.year("o_orderdate").alias("annee")), [1996, 1998, 2050]
))

query("drop_null_date", """
    SELECT l.doc_id, CAST(o.o_orderdate AS DATE) AS date_seance
    FROM labels l JOIN orders o ON l.doc_id * 7 = o.o_orderkey
""")(lambda t: fo.drop_null_date(
    t.labels.join(
        t.orders.select((F.col("o_orderkey")).alias("_k"), F.col("o_orderdate").cast("date").alias("date_seance")),
        F.col("doc_id") * 7 == F.col("_k"), "left",
    )
).select("doc_id", "date_seance"))

query("point_lookup", "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 7")(
    lambda t: fo.point_lookup(t.documents.select("doc_id", "lang", "source", "n_chars"), "doc_id", 7)
)

query("project_include", "SELECT doc_id, source FROM documents")(
    lambda t: fo.project_include(t.documents, "doc_id", "source")
)
query("project_exclude", "SELECT doc_id, lang, source FROM documents")(
    lambda t: fo.project_exclude(t.documents, "text", "n_chars")
)

query("project_defaults", """
    SELECT doc_id AS para_id, 'N/A' AS fonction,
           CASE WHEN doc_id % 2 = 0 THEN source END AS orateur_nom FROM documents
""")(lambda t: fo.project_defaults(
    t.documents.select(
        F.col("doc_id").alias("para_id"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("orateur_nom")
    ),
    {"para_id": ("para_id", ""), "fonction": ("orateur_fonction", "N/A"), "orateur_nom": ("orateur_nom", "N/A")},
))

query("match_word", f"""
    SELECT doc_id FROM documents WHERE list_contains({m.sql_tokens()}, '{m.MAIN_WORD}')
""")(lambda t: search.match_word(t.texts, "text", m.MAIN_WORD, "token").select("doc_id"))

query("match_word_any", f"""
    SELECT doc_id FROM documents WHERE list_has_any({m.sql_tokens()}, ['von', 'que'])
""")(lambda t: search.match_word(t.texts, "text", "von, QUE", "token").select("doc_id"))

_PROXIMITY = f"""
    words AS (
        SELECT doc_id, unnest(tk) AS w, generate_subscripts(tk, 1) AS pos
        FROM (SELECT doc_id, {m.sql_tokens()} AS tk FROM documents)),
    near AS (
        SELECT DISTINCT a.doc_id, b.w
        FROM words a JOIN words b ON a.doc_id = b.doc_id AND a.w = '{m.MAIN_WORD}'
             AND abs(a.pos - b.pos) BETWEEN 1 AND 6)"""

query("match_proximity", f"""
    WITH {_PROXIMITY} SELECT doc_id FROM near WHERE w = '{m.NEAR_WORD}'
""")(lambda t: search.match_proximity(
    t.texts.select("doc_id", "text"), "text", m.MAIN_WORD, m.NEAR_WORD, 5, "token"
).select("doc_id"))

query("filter_topic", f"""
    SELECT lang, count(*) AS n FROM documents
    WHERE list_contains({m.sql_tokens()}, 'that') GROUP BY lang
""")(lambda t: search.filter_topic(t.texts, "text", "that", "token").groupBy("lang").agg(
    F.count("*").alias("n")
))


def _similar(t: Tables):
    # the most frequent words of short texts stand for a model's similar words
    return t.spark.createDataFrame(
        [("und", 0.9), ("von", 0.8), ("die", 0.7), ("la", 0.6), ("absent", 0.5)], "word string, score double"
    )


query("similar_words_paragraphs", f"""
    WITH {_PROXIMITY},
    similar_words(word, score) AS (
        VALUES ('und', 0.9), ('von', 0.8), ('die', 0.7), ('la', 0.6), ('absent', 0.5))
    SELECT s.word, CAST(s.score AS DOUBLE) AS score, count(n.doc_id) AS paragraphs
    FROM similar_words s LEFT JOIN near n ON n.w = s.word GROUP BY s.word, s.score
""")(lambda t: search.similar_words_paragraphs(
    t.texts, _similar(t), "doc_id", "text", m.MAIN_WORD, 5, "token"
))

# French analysis: words after elision, compared by stem
_STEMMED = f"""
    french_words AS (
        SELECT doc_id, unnest(tk) AS word, generate_subscripts(tk, 1) AS pos
        FROM (SELECT doc_id, {m.sql_french_tokens()} AS tk FROM documents)),
    {m.sql_stems("french_words")},
    placed AS (SELECT doc_id, pos, stem FROM french_words JOIN stems USING (word))"""

query("match_word_french", f"""
    WITH {_STEMMED} SELECT DISTINCT doc_id FROM placed WHERE stem IN ('that', 'anement')
""")(lambda t: search.match_word(t.texts, "text", "L’Thates, anementes de").select("doc_id"))

# a phrase and a phrase, the second with a stop word's place left open ("et" between the words)
_PHRASES = f"""{_STEMMED},
    a AS (SELECT x.doc_id, x.pos AS s, x.pos + 1 AS e FROM placed x JOIN placed y
          ON x.doc_id = y.doc_id AND y.pos = x.pos + 1 AND x.stem = 'in' AND y.stem = 'the'),
    b AS (SELECT x.doc_id, x.pos AS s, x.pos + 2 AS e FROM placed x JOIN placed y
          ON x.doc_id = y.doc_id AND y.pos = x.pos + 2 AND x.stem = 'of' AND y.stem = 'and'),
    gaps AS (SELECT a.doc_id, greatest(b.s - a.e, a.s - b.e) - 1 AS gap FROM a JOIN b
             ON a.doc_id = b.doc_id AND (b.s > a.e OR a.s > b.e))"""
query("match_proximity_phrases", f"""
    WITH {_PHRASES} SELECT doc_id, min(gap)::INTEGER AS least_gap FROM gaps GROUP BY doc_id HAVING min(gap) <= 20
""")(lambda t: search.proximity(t.texts.select("doc_id", "text"), "text", "in thes", "of et and").where("least_gap <= 20").select(
    "doc_id", "least_gap"))

query("near_word_pairs", f"""
    WITH {_STEMMED}, similar_words(word, stem) AS (
        VALUES ('tiones', 'tion'), ('Thates', 'that'), ('erer', 'erer'), ('absent', 'absent')),
    a AS (SELECT x.doc_id, x.pos AS s, x.pos + 1 AS e FROM placed x JOIN placed y
          ON x.doc_id = y.doc_id AND y.pos = x.pos + 1 AND x.stem = 'in' AND y.stem = 'the')
    SELECT DISTINCT w.word, p.doc_id FROM a JOIN placed p ON a.doc_id = p.doc_id
        AND (p.pos BETWEEN a.s - 6 AND a.s - 1 OR p.pos BETWEEN a.e + 1 AND a.e + 6) JOIN similar_words w ON w.stem = p.stem
""")(lambda t: search.near_word_pairs(
    t.texts, t.spark.createDataFrame([("tiones",), ("Thates",), ("erer",), ("absent",)], "word string"),
    "doc_id", "text", "in thes", 5))


# joins


query("lookup_dates", """
    SELECT l.doc_id, CAST(o.o_orderdate AS DATE) AS date_seance
    FROM labels l LEFT JOIN orders o ON l.doc_id * 7 = o.o_orderkey
""")(lambda t: jo.lookup_dates(
    t.labels.select("doc_id", (F.col("doc_id") * 7).alias("para_id")),
    t.orders.select(F.col("o_orderkey").alias("para_id"), F.col("o_orderdate").cast("date").alias("date_seance")),
    "para_id",
).select("doc_id", "date_seance"))

query("lookup_field", """
    SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")(lambda t: jo.lookup_field(t.documents.select("doc_id"), t.labels, "doc_id", "quality"))

query("lookup_field_cleaned", """
    SELECT l.doc_id, d.source AS orateur_nom FROM labels l JOIN documents d USING (doc_id)
""")(lambda t: jo.lookup_field(
    t.labels.select("doc_id"),
    t.documents.select("doc_id", F.concat(F.lit(" M. "), F.col("source"), F.lit(" ., ")).alias("orateur_nom")),
    "doc_id", "orateur_nom", clean=True,
))

# order lines as deputy rows: several per customer, the newest one gives the party
_SQL_PARTY = """
    deputies AS (
        SELECT 'Customer ' || o_custkey AS nom, o_orderpriority AS groupe,
               row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn
        FROM orders),
    joined AS (
        SELECT c.c_custkey, 'Customer ' || c.c_custkey AS orateur_nom, d.groupe
        FROM customer c LEFT JOIN deputies d ON d.nom = 'Customer ' || c.c_custkey AND d.rn = 1)"""


def _party(t: Tables):
    deputies = t.orders.select(
        F.lit("Customer").alias("prenom"), F.col("o_custkey").cast("string").alias("nom"),
        F.col("o_orderpriority").alias("groupe"), "o_orderdate", "o_orderkey",
    )
    speakers = t.customer.select(
        "c_custkey", F.concat(F.lit("Customer "), F.col("c_custkey")).alias("orateur_nom")
    )
    return jo.join_party(
        speakers, deputies, "orateur_nom", tx.full_name(F.col("prenom"), F.col("nom")),
        [F.desc("o_orderdate"), F.asc("o_orderkey")],
    )


query("join_party", f"WITH {_SQL_PARTY} SELECT * FROM joined")(_party)

query("unmatched_speakers", f"""
    WITH {_SQL_PARTY}
    SELECT count(*) AS unmatched FROM (SELECT DISTINCT orateur_nom FROM joined WHERE groupe IS NULL)
""")(lambda t: jo.unmatched_speakers(_party(t), "orateur_nom", "groupe"))

_FAMILIES = {"Nord": ["NATION_0", "NATION_1", "NATION_2"], "Sud": ["NATION_10", "NATION_11"]}

query("map_family", """
    SELECT c.c_custkey, CASE WHEN n.n_name IN ('NATION_0', 'NATION_1', 'NATION_2') THEN 'Nord'
        WHEN n.n_name IN ('NATION_10', 'NATION_11') THEN 'Sud' ELSE 'Non inscrit' END AS groupe_politique
    FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
""")(lambda t: jo.map_family(
    t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left"),
    party="n_name", families=_FAMILIES,
).select("c_custkey", "groupe_politique"))

query("map_literal", """
    SELECT n_name, CASE WHEN n_name IN ('NATION_0', 'NATION_1', 'NATION_2') THEN 'Nord'
        WHEN n_name IN ('NATION_10', 'NATION_11') THEN 'Sud' END AS famille
    FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n_name
""")(lambda t: t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
    "n_name", F.try_element_at(jo.map_literal(_FAMILIES), F.col("n_name")).alias("famille")
).distinct())

query("anti_join_existing", """
    SELECT c_custkey FROM customer
    WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)
""")(lambda t: jo.anti_join_existing(
    t.customer.select("c_custkey"),
    t.orders.where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"],
))

query("semi_join_common", """
    SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
""")(lambda t: jo.semi_join_common(t.documents.select("doc_id", "source"), t.labels, ["doc_id"]))


# set operations

query("union_all", """
    SELECT doc_id, lang, 'en' AS part FROM documents WHERE lang = 'en'
    UNION ALL SELECT doc_id, lang, 'all' AS part FROM documents
""")(lambda t: sets.union_all(
    t.documents.where("lang = 'en'").select("doc_id", "lang", F.lit("en").alias("part")),
    t.documents.select("doc_id", "lang", F.lit("all").alias("part")),
))
query("except_ids", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")(
    lambda t: sets.except_ids(t.documents, t.labels, "doc_id")
)
query("intersect_ids", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")(
    lambda t: sets.intersect_ids(t.documents, t.labels, "doc_id")
)
query("distinct_ids", "SELECT DISTINCT conv_id FROM conversations")(
    lambda t: sets.distinct_ids(t.conversations, "conv_id")
)


# sorts and top-k

query("latest_sample", """
    SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id LIMIT 3
""")(lambda t: topk.latest_sample(t.events, "ts", "event_id").select("event_id", "ts", "event_type"))

query("search_theme", f"""
    WITH {m.SQL_INTERVENTIONS},
    toks AS (SELECT *, {m.sql_tokens("texte")} AS tk FROM interventions),
    hits AS (
        SELECT unnest(['la', 'that', 'von', 'que']) AS theme, tk, para_id, date_seance, orateur_nom, section_id
        FROM toks),
    ranked AS (
        SELECT theme, para_id, date_seance, orateur_nom, section_id,
               CAST(row_number() OVER (PARTITION BY theme ORDER BY date_seance DESC, para_id) AS INTEGER) AS "rank"
        FROM hits WHERE list_contains(tk, theme))
    SELECT * FROM ranked WHERE "rank" <= 10
""")(lambda t: topk.newest_by_theme(
    # hits are found before the dates are joined: no text travels
    m.dated(t, topk.theme_hits(t.texts, m.THEMES, "text", mode="token").select(
        F.col("doc_id").alias("para_id"), F.col("source").alias("orateur_nom"), F.col("lang").alias("section_id"), "theme")),
    [F.desc("date_seance"), F.asc("para_id")], ["para_id", "date_seance", "orateur_nom", "section_id"],
))

query("top_speakers", """
    SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10
""")(lambda t: topk.top_speakers(t.documents, "source"))

query("worst_by_group", f"""
    WITH {m.SQL_SENTIMENTS}
    SELECT s.para_id, round({m.SQL_SCORE}, 6) AS score, e.props
    FROM sentiments s JOIN events e ON s.para_id = e.event_id
    WHERE s.groupe_politique = 'Centre' ORDER BY {m.SQL_SCORE}, s.para_id LIMIT 10
""")(lambda t: topk.worst_by_group(
    m.sentiments(t), "groupe_politique", "Centre",
    F.expr("-2.0D * very_negative - 1.0D * negative + 1.0D * positive + 2.0D * very_positive"),
    "para_id", t.events, "props", "event_id",
).select("para_id", F.round("score", 6).alias("score"), "props"))

query("lowest_by_column", f"""
    WITH {m.SQL_SENTIMENTS}
    SELECT para_id, groupe_politique, round(very_positive, 6) AS score FROM sentiments
    ORDER BY very_positive, para_id LIMIT 10
""")(lambda t: topk.lowest_by_column(m.sentiments(t), F.col("very_positive"), "para_id").select(
    "para_id", "groupe_politique", F.round("score", 6).alias("score")
))

query("first_missing", """
    WITH missing AS (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
    SELECT doc_id, greatest((SELECT count(*) FROM missing) - 20, 0) AS not_shown
    FROM missing ORDER BY doc_id LIMIT 20
""")(lambda t: topk.first_missing(t.documents, t.labels, "doc_id"))

query("first_errors", f"""
    WITH {m.SQL_FILE_STATS}
    SELECT filename, error_message,
           greatest((SELECT count(*) FROM file_stats WHERE status = 'failed') - 5, 0) AS not_shown
    FROM file_stats WHERE status = 'failed' ORDER BY filename LIMIT 5
""")(lambda t: topk.first_errors(m.file_stats(t), ["filename"]).select(
    "filename", "error_message", "not_shown"
))

query("first_n_texts", """
    SELECT doc_id, n_chars FROM documents WHERE text IS NOT NULL ORDER BY doc_id LIMIT 1000
""")(lambda t: fo.first_n_texts(t.documents, "text", ["doc_id"]).select("doc_id", "n_chars"))

query("result_cap", """
    SELECT doc_id, source FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100
""")(lambda t: fo.result_cap(
    t.documents, [F.desc("n_chars"), "doc_id"], 100
).select("doc_id", "source"))
