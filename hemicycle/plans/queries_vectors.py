"""Registered queries: vectors, similar words, models."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from hemicycle.functions import scores as sc
from hemicycle.functions import vectors as vx
from hemicycle.operators import codes
from hemicycle.operators import cooccurrence as co
from hemicycle.operators import sentiment as se
from hemicycle.operators import vectors as vo
from hemicycle.operators import words as wo
from hemicycle.plans import analyses
from hemicycle.plans import mapping as m
from hemicycle.plans.registry import Tables, query, r6, rounded
from hemicycle.schemas import CLASSES
from hemicycle.session import scratch_path
from hemicycle.sources import vectors as vs

_V = f"WITH {m.SQL_EMBEDDINGS}"


def _query_vector(t: Tables):
    """The first vector as the query: a one-row frame, used as a scalar subquery."""
    return t.embeddings.where("vec_id = 0").select("embedding")


def _query_list(t: Tables) -> list[float]:
    return list(_query_vector(t).first()[0])


def _year_centroids(t: Tables):
    return vo.vector_centroid(m.dated_embeddings(t), "annee", "embedding")


query("similarity_join", f"""
    {_V} SELECT vec_id, round(list_cosine_similarity(v, (SELECT v FROM vecs WHERE vec_id = 0)), 6) AS score FROM vecs
""")(lambda t: rounded(vo.similarity_to(t.embeddings, "embedding", _query_vector(t)).select("vec_id", "score"), "score"))

query("cosine", """
    WITH a AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    firsts AS (SELECT label, min_by(v, vec_id) AS f FROM a GROUP BY label)
    SELECT vec_id, round(list_cosine_similarity(v, f), 6) AS cosine,
           round(1 - list_cosine_similarity(v, f), 6) AS drift
    FROM a JOIN firsts USING (label)
""")(lambda t: rounded(t.embeddings.join(
    t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("f")), "label"
).select(
    "vec_id", vx.cosine(F.col("embedding"), F.col("f")).alias("cosine"),
    vx.drift(F.col("embedding"), F.col("f")).alias("drift"),
), "cosine", "drift"))

query("drift", f"""
    {_V} SELECT vec_id, round(1 - list_cosine_similarity(v, (SELECT v FROM vecs WHERE vec_id = 1)), 6) AS drift
    FROM vecs WHERE vec_id <> 1
""")(lambda t: rounded(
    t.embeddings.where("vec_id <> 1").withColumn(
        "_q", t.embeddings.where("vec_id = 1").select("embedding").scalar()
    ).select("vec_id", vx.drift(F.col("embedding"), F.col("_q")).alias("drift")), "drift"))

query("l2_normalise", """
    SELECT vec_id, CAST(generate_subscripts(u, 1) - 1 AS INTEGER) AS dim, round(unnest(u), 6) AS value FROM (
        SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 3
            / (3 * sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y))))) AS u
        FROM embeddings)
""")(lambda t: rounded(vo.to_long(t.embeddings.select("vec_id", vx.l2_normalise(
    F.transform("embedding", lambda x: x.cast("double") * 3)
).alias("u")), "vec_id", "u"), "value"))

query("softmax", """
    SELECT vec_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS dim, round(unnest(p), 6) AS value FROM (
        SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM (
            SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: exp(x)) AS e FROM embeddings))
""")(lambda t: rounded(vo.to_long(t.embeddings.select(
    "vec_id", sc.softmax(F.col("embedding")).alias("p")
), "vec_id", "p"), "value"))

query("vector_centroid", f"""
    {_V}, {m.sql_centroids("annee")}
    SELECT annee, dim, round(value, 6) AS value FROM means
""")(lambda t: rounded(vo.to_long(_year_centroids(t), "annee"), "value"))

query("group_centroids", f"""
    {_V}, {m.sql_centroids("label")}, sizes AS (SELECT label, count(*) AS n FROM vecs GROUP BY label)
    SELECT label, n, dim, round(value, 6) AS value FROM means JOIN sizes USING (label) WHERE label IN (0, 2, 4, 77)
""")(lambda t: rounded(
    vo.group_centroids(t.embeddings, "label", "embedding", [0, 2, 4, 77]).select(
        "label", "n", F.posexplode("centroid").alias("dim", "value")
    ), "value"))

query("pairwise_similarity", f"""
    {_V}, {m.sql_centroids("label")}
    SELECT a.label AS a, b.label AS b, round(list_cosine_similarity(a.c, b.c), 6) AS similarity
    FROM centroids a, centroids b
""")(lambda t: rounded(
    vo.pairwise_similarity(vo.vector_centroid(t.embeddings, "label", "embedding"), "label"), "similarity"
))

query("drift_year_to_year", f"""
    {_V}, {m.sql_centroids("annee")},
    lagged AS (SELECT annee, c, lag(annee) OVER w AS from_year, lag(c) OVER w AS p
               FROM centroids WINDOW w AS (ORDER BY annee))
    SELECT from_year, annee AS to_year, round(list_cosine_similarity(p, c), 6) AS similarity,
           round(1 - list_cosine_similarity(p, c), 6) AS drift
    FROM lagged WHERE from_year IS NOT NULL
""")(lambda t: rounded(vo.drift_year_to_year(_year_centroids(t)), "similarity", "drift"))

query("drift_cumulative", f"""
    {_V}, {m.sql_centroids("annee")}
    SELECT annee, round(list_cosine_similarity(c, (SELECT min_by(c, annee) FROM centroids)), 6) AS similarity,
           abs(round(1 - list_cosine_similarity(c, (SELECT min_by(c, annee) FROM centroids)), 6)) AS drift
    FROM centroids
""")(lambda t: rounded(
    vo.drift_cumulative(_year_centroids(t)), "similarity", "drift"
).withColumn("drift", F.abs("drift")))

query("topk_per_year", f"""
    {_V}, scored AS (SELECT vec_id, annee, list_cosine_similarity(v, (SELECT v FROM vecs WHERE vec_id = 0)) AS s FROM vecs),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY annee ORDER BY s DESC, vec_id) AS INTEGER) AS "rank" FROM scored)
    SELECT annee, "rank", vec_id, round(s, 6) AS score FROM ranked WHERE "rank" <= 3
""")(lambda t: rounded(
    vo.topk_per_year(m.dated_embeddings(t), "annee", "vec_id", "embedding", _query_vector(t), 3)
    .select("annee", "rank", "vec_id", "score"), "score"))

_KNN = f"""
    {_V} SELECT vec_id, round(list_cosine_similarity(v, (SELECT v FROM vecs WHERE vec_id = 0)), 6) AS score
    FROM vecs ORDER BY list_cosine_similarity(v, (SELECT v FROM vecs WHERE vec_id = 0)) DESC, vec_id LIMIT 10
"""
query("knn_search", _KNN)(lambda t: rounded(
    vo.knn_search(t.embeddings, "vec_id", "embedding", _query_vector(t), 10).select("vec_id", "score"), "score"
))
query("knn_search_arrow", _KNN)(lambda t: rounded(
    vo.knn_search_arrow(t.embeddings, "vec_id", "embedding", _query_list(t), 10), "score"
))
query("topk_per_year_fixed", f"""
    {_V}, scored AS (SELECT vec_id, annee, list_cosine_similarity(v, (SELECT v FROM vecs WHERE vec_id = 0)) AS s FROM vecs),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY annee ORDER BY s DESC, vec_id) AS rn FROM scored)
    SELECT annee, vec_id, round(s, 6) AS score FROM ranked WHERE rn <= 5
""")(lambda t: rounded(
    vo.topk_per_year(m.dated_embeddings(t), "annee", "vec_id", "embedding", _query_list(t), 5)
    .select("annee", "vec_id", "score"), "score"))
query("knn_search_filtered", f"""
    {_V} SELECT vec_id, label, round(list_cosine_similarity(v, (SELECT v FROM vecs WHERE vec_id = 0)), 6) AS score
    FROM vecs WHERE label = 3
    ORDER BY list_cosine_similarity(v, (SELECT v FROM vecs WHERE vec_id = 0)) DESC, vec_id LIMIT 5
""")(lambda t: rounded(vo.knn_search(
    t.embeddings, "vec_id", "embedding", _query_vector(t), 5, F.col("label") == 3
).select("vec_id", "label", "score"), "score"))
query("knn_search_lsh")(lambda t: rounded(
    vo.knn_search_lsh(t.embeddings, "vec_id", "embedding", _query_list(t), 10).select("vec_id", "score"), "score"
))



def _coded(t: Tables):
    return codes.with_codes(t.embeddings, "embedding", len(_query_list(t)))


query("knn_search_codes", _KNN)(lambda t: rounded(codes.knn_search_codes(
    _coded(t), "vec_id", "embedding", _query_list(t), 10).select("vec_id", "score"), "score"))
# a tenth of the rows is compared by vectors: those at or above the quantile of nine tenths
query("knn_codes_rows_read", """
    SELECT count(*) AS "rows", count(*) - CAST(ceil(count(*) * 0.9) AS BIGINT) + 1 AS compared FROM embeddings
""")(lambda t: _coded(t).agg(F.count("*").alias("rows")).join(
    codes.candidates(_coded(t), "vec_id", _query_list(t)).agg(F.count("*").alias("compared"))))

query("nearest_words", f"""
    {_V} SELECT 'w' || vec_id AS word, round(list_cosine_similarity(v, (SELECT v FROM vecs WHERE vec_id = 5)), 6) AS score
    FROM vecs WHERE vec_id <> 5
    ORDER BY list_cosine_similarity(v, (SELECT v FROM vecs WHERE vec_id = 5)) DESC, 'w' || vec_id LIMIT 10
""")(lambda t: rounded(wo.nearest_words(
    t.embeddings.select(F.format_string("w%d", "vec_id").alias("word"), "embedding"), "word", "embedding", "w5"
), "score"))

query("first_seen_vector", f"""
    WITH firsts AS (
        SELECT word, min(doc_id) AS first_seen
        FROM (SELECT doc_id, unnest({m.sql_tokens()}) AS word
              FROM documents JOIN embeddings ON doc_id = vec_id) GROUP BY word)
    SELECT word, first_seen, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total
    FROM firsts JOIN embeddings ON first_seen = vec_id
""")(lambda t: wo.first_seen_vector(
    t.texts.join(t.embeddings, F.col("doc_id") == F.col("vec_id")).select("doc_id", "text", "embedding"),
    "text", "doc_id", "embedding", t.embeddings.withColumnRenamed("vec_id", "doc_id"),
).select("word", "first_seen", r6(F.aggregate(
    "embedding", F.lit(0.0), lambda s, x: s + x.cast("double")
)).alias("total")))


# models


def _lexicon():
    return {
        "very_negative": ("der", "die", "von"), "negative": ("und", "den"),
        "positive": ("the", "of", "and"), "very_positive": ("la", "de", "que"),
    }


def _sql_hits(c: str) -> str:
    words = ", ".join(f"'{w}'" for w in _lexicon()[c])
    return f"len(list_filter(tk, lambda x: x IN ({words})))"


_LOGITS = ", ".join(
    ("1.0::DOUBLE" if c == "neutral" else f"{_sql_hits(c)} * 6.0::DOUBLE / sqrt(greatest(len(tk), 1)::DOUBLE)") + f" AS l_{c}"
    for c in CLASSES
)
_TOP = "greatest(" + ", ".join(f"l_{c}" for c in CLASSES) + ")"
_TOTAL = "(" + " + ".join(f"exp(l_{c} - {_TOP})" for c in CLASSES) + ")"
query("score_sentiment", f"""
    WITH logits AS (SELECT doc_id, {_LOGITS} FROM (SELECT doc_id, {m.sql_tokens()} AS tk FROM documents))
    SELECT doc_id, {", ".join(f"round(exp(l_{c} - {_TOP}) / {_TOTAL}, 6) AS {c}" for c in CLASSES)} FROM logits
""")(lambda t: rounded(se.score_sentiment(
    t.texts.select("doc_id", "text"), "text", _lexicon()
).drop("text"), *CLASSES))


def _load_length_scorer():
    def score(texts: list[str]) -> list[list[float]]:
        return [[(len(x) % (i + 7) + 1.0) for i in range(5)] for x in texts]

    def normalised(texts: list[str]) -> list[list[float]]:
        return [[v / sum(row) for v in row] for row in score(texts)]

    return normalised


_PARTS = [f"(length(text) % {i + 7} + 1.0::DOUBLE)" for i in range(5)]
query("score_with_model", f"""
    SELECT doc_id, {", ".join(f"round({p} / ({' + '.join(_PARTS)}), 6) AS {c}" for p, c in zip(_PARTS, CLASSES))}
    FROM documents
""")(lambda t: rounded(se.score_with_model(
    t.texts.select("doc_id", "text"), "text", _load_length_scorer
).drop("text"), *CLASSES))

# hashes differ between engines, lengths do not: unit vectors, zero for a text without a word
query("embed_texts", f"""
    SELECT doc_id, {vo.DIMENSIONS} AS size, CASE WHEN len({m.sql_tokens()}) > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS length FROM documents
""")(lambda t: vo.embed_texts(t.texts.select("doc_id", "text"), "text").select(
    "doc_id", F.size("texte_embedding").alias("size"), F.round(vx.norm(F.col("texte_embedding")), 4).alias("length")))


def _load_length_embedder():
    import numpy as np

    return lambda texts: np.array([[len(x), len(x) % 10, 1.0] for x in texts], dtype="float32")


query("embed_with_model", """
    SELECT doc_id, round(length(text) / sqrt(length(text)::DOUBLE * length(text)
           + (length(text) % 10) * (length(text) % 10) + 1), 4) AS x FROM documents
""")(lambda t: vo.embed_with_model(
    t.texts.select("doc_id", "text"), "text", _load_length_embedder
).select("doc_id", F.round(F.element_at("texte_embedding", 1).cast("double"), 4).alias("x")))

# documents of the corpus that have a vector keep it, the others are computed
_HALF = """SELECT d.doc_id, d.text, e.vec_id FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id"""


def _half_embedded(t: Tables):
    vectors = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("texte_embedding"))
    return t.texts.select("doc_id", "lang", "text").join(vectors, "doc_id", "left")


def _maintained(t: Tables):
    """Vectors kept beside the texts over three runs: all, none new, and the changed language."""
    path = scratch_path(t.spark, "vectors")
    texts = t.documents.select("doc_id", "lang", "text")
    changed = texts.withColumn("text", F.when(F.col("lang") == "fr", F.concat("text", F.lit(" fin"))).otherwise(F.col("text")))
    runs = [vs.update_vectors(df, path, "doc_id", "text") for df in (texts, texts, changed)]
    stored = vs.with_vectors(changed, path, "doc_id", "text")
    # the length of a vector, and whether it is that of the present text
    fits = F.size("texte_embedding").alias("size"), F.lit(runs[0]).cast("long").alias("first"), F.lit(runs[1]).cast("long").alias(
        "again"), F.lit(runs[2]).cast("long").alias("changed")
    return stored.select("doc_id", *fits)


query("enrich_embeddings", """
    WITH n AS (SELECT count(*) FILTER (WHERE trim(text) <> '') AS first, count(*) FILTER (WHERE lang = 'fr') AS changed FROM documents)
    SELECT doc_id, CAST(CASE WHEN trim(text) <> '' THEN 256 END AS INTEGER) AS size, first, 0::BIGINT AS again, changed FROM documents, n
""")(_maintained)

query("enrichment_counts", """
    SELECT count(*) AS "rows", count(*) AS with_vector, count(*) - count(e.vec_id) AS added, 0 AS without_vector
    FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id
""")(lambda t: vo.enrichment_counts(
    _half_embedded(t),
    vo.enrich_embeddings(_half_embedded(t), "text", lambda df, text, out: vo.embed_texts(df, text, out, 64)),
).withColumn("without_vector", F.col("without_vector").cast("int")))

query("add_vector_column", "SELECT doc_id, TRUE AS missing FROM documents")(
    lambda t: vo.add_vector_column(t.documents).select("doc_id", F.col("texte_embedding").isNull().alias("missing"))
)


def _model(t: Tables):
    return wo.train_word2vec(t.texts, "text", vector_size=16, epochs=1, min_count=3, partitions=4)


# the vocabulary is exact: every word that occurs three times has a vector
query("train_word2vec", f"""
    SELECT word, 16 AS size FROM (SELECT unnest({m.sql_tokens()}) AS word FROM documents) GROUP BY word HAVING count(*) >= 3
""")(lambda t: _model(t).getVectors().select("word", F.size(vector_to_array("vector")).alias("size")))
query("similar_words")(lambda t: wo.similar_words(_model(t), "und", 10))
query("analyse_similar_words")(lambda t: wo.analyse_similar_words(
    t.texts, _model(t), "doc_id", "text", "und", 5, 5
))


# co-occurrence


_SQL_CELLS = f"""
    WITH d AS (SELECT {m.sql_tokens()} AS t FROM documents),
    known AS (SELECT word FROM (SELECT unnest(t) AS word FROM d) GROUP BY word HAVING count(*) >= {co.MIN_COUNT}),
    near AS (SELECT unnest(t[:len(t) - k]) AS a, unnest(t[k + 1:]) AS b FROM d, range(1, {co.WINDOW + 1}) r(k) WHERE len(t) > k),
    once AS (SELECT a, b, count(*) AS n FROM near WHERE a IN (FROM known) AND b IN (FROM known) GROUP BY a, b),
    counts AS (SELECT word, context, CAST(sum(n) AS BIGINT) AS n
               FROM (SELECT a AS word, b AS context, n FROM once UNION ALL SELECT b, a, n FROM once) GROUP BY 1, 2),
    margins AS (SELECT word, sum(n)::DOUBLE AS m FROM counts GROUP BY word),
    cells AS (SELECT c.word, context, n, ln(n::DOUBLE * (SELECT sum(n)::DOUBLE FROM counts) / (w.m * x.m)) AS a
              FROM counts c JOIN margins w ON c.word = w.word JOIN margins x ON c.context = x.word)
"""
query("cooccurrence_counts", f"{_SQL_CELLS} SELECT * FROM counts")(lambda t: co.pair_counts(t.texts, "text"))


def _information(t: Tables):
    words = co.known(t.texts, "text")
    return co.mutual_information(co.pair_counts(t.texts, "text", words=words, numbered=True),
                                 co.pair_margins(t.texts, "text", words=words, numbered=True), words)


query("mutual_information", f"{_SQL_CELLS} SELECT word, context, round(a, 6) AS a FROM cells WHERE a > 1e-9")(
    lambda t: rounded(_information(t).where("a > 1e-9"), "a"))
# directions have no fixed sign, so vectors are held by their properties: which words, how many numbers
query("cooccurrence_vectors", f"""
    {_SQL_CELLS} SELECT word, least(64, count(*) OVER ())::INTEGER AS size FROM cells WHERE a > 0 GROUP BY word
""")(lambda t: co.word_vectors(t.texts, "text").select("word", F.size("vector").alias("size")))


# whole analyses


def _own_text(t: Tables):
    """Of the ten rows nearest to the text of document 0, those that are not to be told from it."""
    text = t.documents.where("doc_id = 0").first()["text"]
    coded = vo.embed_texts(t.texts.select("doc_id", "text"), "text").drop("text")
    return vo.semantic_search(coded, "doc_id", "texte_embedding", text, 10).select(
        "doc_id", F.round("score", 6).alias("score")).where("score = 1")


query("semantic_search", """
    SELECT doc_id, 1.0::DOUBLE AS score FROM documents
    WHERE text = (SELECT text FROM documents WHERE doc_id = 0) ORDER BY doc_id LIMIT 10
""")(_own_text)

query("word_sentiment_series", f"""
    WITH logits AS (SELECT doc_id, {_LOGITS} FROM (SELECT doc_id, {m.sql_tokens()} AS tk FROM documents) WHERE list_contains(tk, 'the')),
    classes AS (SELECT doc_id, {", ".join(f"exp(l_{c} - {_TOP}) / {_TOTAL} AS {c}" for c in CLASSES)} FROM logits),
    dated AS (SELECT CAST(o_orderdate AS DATE) AS date_seance, o_orderpriority AS groupe_politique, c.*
              FROM classes c JOIN orders ON doc_id = o_orderkey)
    SELECT date_seance, groupe_politique, round(avg({m.SQL_SCORE}), 6) AS mean, count(*) AS "count" FROM dated GROUP BY 1, 2
""")(lambda t: rounded(analyses.word_sentiment_series(
    t.texts, t.orders.select(
        F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").cast("date").alias("date_seance"),
        F.col("o_orderpriority").alias("groupe_politique")),
    "doc_id", "text", "date_seance", "the", "groupe_politique", "token", _lexicon()), "mean"))


def _topic_rows(t: Tables):
    texts = t.texts.select(F.col("doc_id").alias("vec_id"), "text")
    return m.dated_embeddings(t).select("vec_id", "annee", "embedding").join(texts, "vec_id")


_TOPIC = f"""
    WITH vecs AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS annee, CAST(embedding AS DOUBLE[]) AS v
                  FROM embeddings JOIN orders ON vec_id = o_orderkey JOIN documents ON vec_id = doc_id
                  WHERE list_contains({m.sql_tokens()}, 'the')), {m.sql_centroids("annee")}
"""
query("topic_drift", f"""
    {_TOPIC}, lagged AS (SELECT annee, c, lag(annee) OVER w AS from_year, lag(c) OVER w AS p FROM centroids WINDOW w AS (ORDER BY annee))
    SELECT from_year, annee AS to_year, round(list_cosine_similarity(p, c), 6) AS similarity,
           round(1 - list_cosine_similarity(p, c), 6) AS drift FROM lagged WHERE from_year IS NOT NULL
""")(lambda t: rounded(analyses.topic_drift(_topic_rows(t), "text", "annee", "embedding", "the", "token"), "similarity", "drift"))
