import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hemicycle.functions import scores as sc
from hemicycle.functions import text as tx
from hemicycle.operators import aggregates as ag
from hemicycle.operators import filters as fo
from hemicycle.operators import joins as jo
from hemicycle.operators import ordering, search
from hemicycle.operators import quality as qo
from hemicycle.operators import sentiment as se
from hemicycle.operators import vectors as vo
from hemicycle.operators import words as wo
from hemicycle.schemas import CLASSES, INTERVENTIONS
from hemicycle.sources import vectors as vs


def plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows belong to one key, some keys and run keys are NULL."""
    rng = random.Random(7)
    keys = ["hot"] * 400 + [None] * 100 + [f"k{rng.randrange(40)}" for _ in range(700)]
    rng.shuffle(keys)
    return [(k, i, rng.choice(["a", "a", "b", None]), f"t{i}") for i, k in enumerate(keys)]


def brute_runs(rows):
    last, out = {}, {}
    for key, at, kind, text in sorted(rows, key=lambda r: r[1]):
        if kind is None:
            continue
        seen = last.get(key)
        if seen and seen[0] == kind:
            out[seen[1]].append(text)
        else:
            last[key] = (kind, at)
            out[at] = [text]
    return {at: " ".join(parts) for at, parts in out.items()}


@pytest.mark.parametrize("rows_per_chunk", [1, 7, 100000])
def test_runs_across_chunks_equal_brute_force(spark, skewed, rows_per_chunk):
    df = spark.createDataFrame(skewed, "key string, at long, kind string, text string")
    chunk = ordering.ordinal_chunk("at", rows_per_chunk)
    merged = ordering.merge_same_para(df, ["key"], ["at"], "kind", "text", chunk, ["at"])
    got = {r.run_start.at: r.text for r in merged.collect()}
    assert got == brute_runs(skewed)
    runs = ordering.para_runs(df, ["key"], ["at"], "kind", chunk)
    assert runs.count() == sum(1 for r in skewed if r[2] is not None)
    assert {r.run_start.at for r in runs.collect()} == set(got)


@pytest.mark.parametrize("rows_per_chunk", [1, 13, 100000])
def test_lag_across_chunks_equals_brute_force(spark, skewed, rows_per_chunk):
    df = spark.createDataFrame(skewed, "key string, at long, kind string, text string")
    lagged = ordering.lag_in_key(df, ["key"], ["at"], ["kind", "text"], ordering.ordinal_chunk("at", rows_per_chunk))
    got = {r.at: (r.has_prev, r.prev_kind, r.prev_text) for r in lagged.collect()}
    last, want = {}, {}
    for key, at, kind, text in skewed:
        want[at] = (True, *last[key]) if key in last else (False, None, None)
        last[key] = (kind, text)
    assert got == want


@pytest.mark.parametrize("operator", ["runs", "merge", "lag"])
def test_rows_are_scanned_and_shuffled_once(spark, operator):
    """Block summaries come from the rows' own exchange."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("unused", F.lit("x"))
        hour = F.date_trunc("hour", F.col("ts"))
        df = {
            "runs": lambda: ordering.para_runs(events, ["user_id"], ["ts"], "event_type", hour),
            "merge": lambda: ordering.merge_same_para(events, ["user_id"], ["ts"], "event_type", "props", hour, ["event_id"]),
            "lag": lambda: ordering.lag_in_key(events, ["user_id"], ["ts"], ["event_type"], hour),
        }[operator]()
        df.collect()
        text = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    final = text[: text.index("Initial Plan")]
    assert final.count("FileScan") == 1 and final.count("ReusedExchange") == 1


def test_rank_filter_runs_before_the_shuffle(spark, skewed):
    df = spark.createDataFrame(skewed, "key string, at long, kind string, text string")
    text = plan(jo.latest_per_key(df, ["key"], [F.desc("at")]))
    assert text.count("WindowGroupLimit") >= 2 and "Partial" in text


def test_point_lookup_raises_for_an_unknown_key(spark):
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    assert fo.point_lookup(df, "k", "a").collect() == [("a", 1)]
    with pytest.raises(Exception, match="no row with k = b"):
        fo.point_lookup(df, "k", "b").collect()


def test_blank_lists(spark):
    df = spark.createDataFrame([(1, ["", " "]), (2, []), (3, ["x", ""]), (4, None)], "id int, t array<string>")
    assert sorted(r.id for r in fo.filter_blank_text(df, "t").collect()) == [1, 2, 4]


def brute_near(text, a, b, slop):
    words = text.split()
    pa = [i for i, w in enumerate(words) if w == a]
    pb = [i for i, w in enumerate(words) if w == b]
    return any(0 < abs(i - j) <= slop + 1 for i in pa for j in pb)


@pytest.mark.parametrize("slop", [0, 2, 20])
def test_proximity_equals_brute_force(spark, slop):
    rng = random.Random(slop)
    rows = [(i, " ".join(rng.choice(["m", "n", *"abcdefgh"]) for _ in range(rng.randrange(30)))) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, t string")
    got = {r.id for r in search.match_proximity(df, "t", "m", "n", slop, "token").collect()}
    assert got == {i for i, t in rows if brute_near(t, "m", "n", slop)}
    words = spark.createDataFrame([("n", 0.9), ("a", 0.8), ("zzz", 0.1)], "word string, score double")
    counts = {r.word: r.paragraphs for r in search.similar_words_paragraphs(df, words, "id", "t", "m", slop, "token").collect()}
    assert counts == {w: sum(brute_near(t, "m", w, slop) for _, t in rows) for w in ("n", "a", "zzz")}


def test_match_word_modes(spark):
    df = spark.createDataFrame([(1, "L’immigration, les Migrants."), (2, "rien"), (3, None)], "id int, t string")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(search.match_word(df, "t", "migrants", "token")) == [1]
    assert ids(search.match_word(df, "t", "migrant", "token")) == []
    assert ids(search.match_word(df, "t", "immigration", "token")) == []
    assert ids(search.match_word(df, "t", "rien migrants", "token")) == [1, 2]
    # French analysis is the default
    assert ids(search.match_word(df, "t", "migrant")) == [1]
    assert ids(search.match_word(df, "t", "immigration")) == [1]
    assert ids(search.match_word(df, "t", "les")) == []
    assert ids(search.match_word(df, "t", None)) == [1, 2, 3]


def test_vectors_against_numpy(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(300, 8)).astype("float32")
    m[0] = 0
    years = [2000 + i % 3 * 2 for i in range(300)]
    rows = [(i, years[i], [float(x) for x in m[i]]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, annee int, v array<float>")
    q = [float(x) for x in m[5]]
    norms = np.linalg.norm(m.astype("float64"), axis=1)
    cos = np.divide(m.astype("float64") @ np.array(q), norms * np.linalg.norm(q), out=np.zeros(300), where=norms > 0)
    want = list(np.argsort(-cos, kind="stable")[:10])
    assert [r.id for r in vo.knn_search(df, "id", "v", q, 10).collect()] == want
    assert [r.id for r in vo.knn_search_arrow(df, "id", "v", q, 10).collect()] == want
    near = {r.id for r in vo.knn_search_lsh(df, "id", "v", q, 5, num_candidates=300, tables=8, bucket_length=4.0).collect()}
    assert len(near & set(want[:5])) >= 4
    centroids = vo.vector_centroid(df, "annee", "v")
    for r in centroids.collect():
        assert np.allclose(r.centroid, m[np.array(years) == r.annee].mean(axis=0), atol=1e-6)
    steps = vo.drift_year_to_year(centroids).orderBy("from_year").collect()
    assert [(r.from_year, r.to_year) for r in steps] == [(2000, 2002), (2002, 2004)]
    assert vo.drift_cumulative(centroids).count() == 3
    assert vo.drift_cumulative(centroids.where("annee = 2000")).count() == 0
    matrix = vo.pairwise_similarity(centroids, "annee")
    assert matrix.count() == 9
    assert all(abs(r.similarity - 1) < 1e-9 for r in matrix.where("a = b").collect())
    assert "CartesianProduct" not in plan(matrix) and "NestedLoop" not in plan(matrix)


def test_first_seen_and_nearest_words(spark):
    rows = [(1, "a b", [1.0, 0.0]), (2, "b c", [0.0, 1.0]), (3, "c d", [0.6, 0.8])]
    df = spark.createDataFrame(rows, "o int, t string, v array<float>")
    words = wo.first_seen_vector(df, "t", "o", "v")
    assert sorted((r.word, r.first_seen) for r in words.collect()) == [("a", 1), ("b", 1), ("c", 2), ("d", 3)]
    near = [r.word for r in wo.nearest_words(words, "word", "v", "a", 2).collect()]
    assert near == ["b", "d"]


def test_embeddings_are_unit_vectors_and_only_missing_ones_are_filled(spark):
    df = spark.createDataFrame([(1, "un deux un"), (2, " "), (3, None)], "id int, t string")
    once = vo.enrich_embeddings(df, "t")
    got = {r.id: r.texte_embedding for r in once.collect()}
    assert np.isclose(np.linalg.norm(got[1]), 1) and got[2] is None and got[3] is None
    kept = vo.enrich_embeddings(once.withColumn("texte_embedding", F.array(F.lit(9.0).cast("float"))), "t")
    assert {tuple(r.texte_embedding) for r in kept.collect()} == {(9.0,)}


PAIRS = [
    ("Ce budget est un échec.", "Ce budget est utile."),
    ("Un mauvais texte, encore une crise.", "Un bon texte, enfin un progrès."),
    ("Quelle honte que ce retard !", "Quel texte magnifique !"),
    ("This was a bad day.", "This was a good day."),
]
GRADED = {
    "very_negative": ["Votre réponse est un scandale.", "Ce chantier fut un désastre."],
    "neutral": ["Le vote aura lieu mardi.", "Cet article compte six alinéas."],
    "very_positive": ["Un résultat exceptionnel pour la ville.", "Cette idée est excellente."],
}


def test_lexicon_scores_are_ordered(spark):
    phrases = [p for pair in PAIRS for p in pair] + [p for g in GRADED.values() for p in g]
    scored = se.score_sentiment(spark.createDataFrame([(p,) for p in phrases], "phrase string"), "phrase")
    for r in scored.collect():
        assert abs(sum(r[c] for c in CLASSES) - 1) < 1e-9
    scores = scored.select("phrase", sc.sentiment_index_0_4().alias("score"))
    check = qo.dq_score_order(spark.createDataFrame(PAIRS, "low string, high string"), se.sentiment_index).first()
    assert check.passed and check.value >= 0.75
    by_phrase = {r.phrase: r.score for r in scores.collect()}
    mean = {g: sum(by_phrase[p] for p in ps) / 2 for g, ps in GRADED.items()}
    assert mean["very_negative"] < mean["very_positive"] and 1 <= mean["neutral"] <= 3


def test_a_model_is_loaded_per_task_and_scores_null_as_empty(spark):
    def load():
        return lambda texts: [[float(len(t) == 0), 0, 0, 0, float(len(t) > 0)] for t in texts]

    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, t string")
    got = {r.id: r.very_negative for r in se.score_with_model(df, "t", load).collect()}
    assert got == {1: 0.0, 2: 1.0}


def test_duplicates_and_reconciliation(spark):
    rows = [(1, "a", "x"), (2, "a", "x"), (3, "b", "x"), (4, "b", None), (5, "b", "x"), (6, None, "z"), (7, None, "z")]
    df = spark.createDataFrame(rows, "o long, k string, v string")
    assert sorted(qo.duplicates_by_key(df, ["k"]).collect(), key=str) == [("a", 2), ("b", 3), (None, 2)]
    assert sorted(qo.duplicates_by_long_key(df, ["k"], "o").collect()) == [(1, 2), (3, 3), (6, 2)]
    assert qo.top_duplicates(df, ["k"], "o", 1).collect() == [(3, "b", 3)]
    assert qo.duplicates_kind(df, ["k"], ["v"]).first() == (2, 1)
    diff = {r.o: r.differences for r in qo.duplicate_diff_fields(df, ["k"], "o", ["v"]).collect()}
    assert diff == {2: "", 4: "v", 5: "v", 7: ""}
    left = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    right = spark.createDataFrame([(2,), (3,), (3,), (3,)], "id int")
    r = qo.reconcile_ids(left, right, "id").first()
    assert (r.total_left, r.unique_left, r.total_right, r.unique_right, r.common, r.missing, r.extra) == (3, 2, 4, 2, 1, 1, 1)
    assert (r.duplicates_left, r.duplicates_right, r.match_rate) == (1, 1, 50.0)


def test_histogram_of_one_length(spark):
    df = spark.createDataFrame([("ab",), ("cd",), (None,)], "t string")
    got = {r.bin: r.n for r in ag.histogram_length(df, "t", 4).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 0}


def test_statistics_of_nothing(spark):
    empty = spark.createDataFrame([], "t string, status string, documents_count long, duration_seconds double")
    assert ag.corpus_word_stats(empty, "t").first() == (0, 0, 0, None)
    assert ag.run_statistics(empty).first().success_pct is None
    assert ag.describe_length(empty, "t").first()["mean"] is None


def test_required_fields(spark):
    blank = {f.name: None for f in INTERVENTIONS.fields}
    filled = {**blank, "date_seance": datetime.date(2020, 1, 1), "texte": "t", "section_id": "s", "para_id": "p",
              "legislature": 1, "publication_numero": 2, "orateur_nom": "o"}
    rows = spark.createDataFrame([filled, blank], INTERVENTIONS)
    assert qo.dq_required_fields(rows).first().passed
    assert qo.dq_required_fields(rows.drop("texte")).first().value == 1
    assert qo.dq_required_fields(rows.where("para_id IS NULL")).first().value == 7


CHECKED = qo.Checked("id", "t", "d", "who", "part", ("id", "t"), ("id", "t", "gone"))


def checked_rows(spark, n, extra=()):
    rows = [(i, f"text {i} " * 9, "2020-01-01", f"s{i % 12}", f"p{i % 3}") for i in range(n)]
    return spark.createDataFrame(rows + list(extra), "id int, t string, d string, who string, part string")


def test_full_report_equals_the_single_checks(spark):
    odd = [(None, None, "2020-02-31", "", None), (3, " ", None, None, "p0"), (500, "x", "bad", "s1", "p9")]
    table = checked_rows(spark, 120, odd)
    raw = checked_rows(spark, 130, [(500, "y", None, None, "p8"), (None, "z", None, None, None)])
    got = {r.check: (round(r.value, 6), r.threshold, r.passed) for r in qo.full_report(table, raw, CHECKED).collect()}
    single = qo.quality_report(
        qo.dq_required_fields(table, CHECKED.required), qo.dq_core_fields(table, ["id", "t"]), qo.dq_no_empty_text(table, "t"),
        qo.dq_dates_valid(table, "d"), qo.dq_names_nonempty(table, "who"), qo.dq_short_texts(table, "t"), qo.dq_min_rows(table),
        qo.dq_min_speakers(table, "who"), qo.dq_avg_length(table, "t"), qo.dq_count_tolerance(raw, table),
        qo.dq_ids_exist(raw, table, "id"), qo.dq_metadata_exist(raw, table, "part"))
    want = {r.check: (round(r.value, 6), r.threshold, r.passed) for r in single.collect()}
    assert {k: v for k, v in got.items() if k != "text_equal"} == want
    assert len(got) == 13 and got["text_equal"][0] == 2  # ids 3 and 500


def test_full_report_reads_each_side_once(spark, tmp_path):
    path = str(tmp_path / "t")
    checked_rows(spark, 50).write.parquet(path)
    df = qo.full_report(spark.read.parquet(path), spark.read.parquet(path).where("id > 3"), CHECKED)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("FileScan") == 2 and final.count("Exchange") <= 2


def test_watched_writes_report_without_another_scan(spark, tmp_path):
    watch = qo.Watch(CHECKED)
    watch.over(checked_rows(spark, 120, [(7, None, "x", "", "p")])).write.parquet(str(tmp_path / "t"))
    got = {r.check: (r.value, r.passed) for r in watch.report().collect()}
    assert got["min_rows"] == (121, True) and got["core_fields"] == (1, False) and got["required_fields"] == (1, False)
    assert got["dates_valid"] == (1, False) and got["min_speakers"][1] and len(got) == 9
    empty = qo.Watch(CHECKED)
    empty.over(checked_rows(spark, 0)).write.parquet(str(tmp_path / "e"))
    assert not {r.check: r.passed for r in empty.report().collect()}["min_rows"]


def test_lookups_give_one_row_per_key_and_keep_keyless_rows(spark):
    keys = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e"), (9, "f")], "k int, x string")
    table = spark.createDataFrame([(1, "one"), (1, "uno"), (2, None), (2, "two"), (None, "never")], "k long, v string")
    got = {r.x: r.v for r in jo.lookup_field(keys, table, "k", "v").collect()}
    assert got == {"a": "one", "b": "one", "c": "two", "d": None, "e": None, "f": None}
    deputies = spark.createDataFrame([("A B", "left", 1), ("A B", "right", 2), (None, "none", 3)], "n string, groupe string, y int")
    rows = spark.createDataFrame([("A B", 1), ("X", 2), (None, 3)], "who string, i int")
    party = jo.join_party(rows, deputies, "who", F.col("n"), [F.desc("y")])
    assert {r.i: r.groupe for r in party.collect()} == {1: "right", 2: None, 3: None}
    assert party.columns == ["who", "i", "groupe"]


def test_score_rules(spark):
    phrases = spark.createDataFrame([("very_negative", "non"), ("very_positive", "oui"), ("neutral", "?"), ("positive", "oui")], "label string, text string")
    score = lambda df, text: df.withColumn("score", F.when(F.col(text) == "oui", 4.0).when(F.col(text) == "?", 2.0).otherwise(0.5))
    got = {r.check: (r.value, r.passed) for r in qo.dq_score_references(phrases, score).collect()}
    assert got == {"score_extremes": (3.5, True), "score_neutral": (2.0, True)}
    bad = spark.createDataFrame([(0.5, 0.4), (0.5, 0.5)], "a double, b double")
    assert not qo.dq_score_sums(bad, ("a", "b")).first().passed


def test_search_words_match_text_tokens(spark):
    for query in ("L'Été", "x_y, z", "..."):
        df = spark.createDataFrame([(query,)], "t string")
        assert df.select(tx.tokenize(F.col("t"))).first()[0] == search.query_words(query)


def test_filters_reach_the_scan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = plan(fo.filter_term(docs, "lang", "fr").select("doc_id"))
    assert "EqualTo(lang,fr)" in text and "ReadSchema: struct<doc_id:bigint,lang:string>" in text


@pytest.mark.parametrize("block", [1, 3, 100])
def test_similarity_matrix_by_blocks(spark, block):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(11, 5))
    m[4] = 0
    rows = spark.createDataFrame([(f"g{i}", v.tolist()) for i, v in enumerate(m)] + [("none", None)], "g string, centroid array<double>")
    got = {(r.a, r.b): r.similarity for r in vo.pairwise_similarity(rows, "g", block=block).collect()}
    n = np.linalg.norm(m, axis=1, keepdims=True)
    unit = m / np.where(n > 0, n, 1)
    assert len(got) == 121
    assert all(abs(got[f"g{i}", f"g{j}"] - unit[i] @ unit[j]) < 1e-12 for i in range(11) for j in range(11))
    assert vo.pairwise_similarity(rows.limit(0), "g").count() == 0


def test_vectors_are_maintained_by_change(spark, tmp_path):
    path = str(tmp_path / "v")
    rows = [(1, "one text"), (2, "two texts"), (3, " "), (None, "no key"), (4, None)]
    df = lambda r: spark.createDataFrame(r, "id long, t string")
    assert vs.update_vectors(df(rows), path, "id", "t") == 2
    assert vs.update_vectors(df(rows), path, "id", "t") == 0
    rows[0] = (1, "one other text")
    assert vs.update_vectors(df(rows), path, "id", "t") == 1
    out = {r.id: r.texte_embedding for r in vs.with_vectors(df(rows), path, "id", "t").collect()}
    assert {k for k, v in out.items() if v} == {1, 2} and {len(v) for v in out.values() if v} == {vo.DIMENSIONS}
    direct = vo.embed_texts(df(rows[:1]), "t").first().texte_embedding
    assert out[1] == direct
    # a text that is not the stored one has no vector
    assert vs.with_vectors(df([(2, "changed")]), path, "id", "t").first().texte_embedding is None


def test_word2vec(spark):
    rng = random.Random(1)
    rows = [(" ".join(rng.choice(["alpha beta", "gamma delta"]) for _ in range(6)),) for _ in range(60)]
    model = wo.train_word2vec(spark.createDataFrame(rows, "t string"), "t", vector_size=8, epochs=1)
    found = wo.similar_words(model, "alpha", 2).collect()
    assert len(found) == 2 and all(r.word in ("beta", "gamma", "delta") for r in found)
