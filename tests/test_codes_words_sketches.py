"""Sign codes, co-occurrence vectors and stored sketches."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hemicycle.operators import codes
from hemicycle.operators import cooccurrence as co
from hemicycle.operators import vectors as vo
from hemicycle.operators import words as wo
from hemicycle.plans import analyses, queries_vectors  # noqa: F401
from hemicycle.plans.registry import QUERIES
from hemicycle.session import scratch_path
from hemicycle.sources import sketches, table

RNG_NUMBERED = np.random.default_rng(8)
RNG = np.random.default_rng(11)


def test_codes_prune_and_find(spark):
    points = RNG.normal(size=(3000, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(points)]
    rows += [(9000, None), (9001, []), (9002, [0.0] * 32), (9003, [float("nan")] * 32), (9004, [None] * 32), (9005, [1.0])]
    coded = codes.with_codes(spark.createDataFrame(rows, "id long, v array<double>"), "v", 32).cache()
    assert {r.id for r in coded.where("code IS NULL").collect()} == set(range(9000, 9006))
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    hits = 0
    for q in range(5):
        query = points[q] + RNG.normal(size=32)
        true = set(np.argsort(-(unit @ query))[:10].tolist())
        near = {r.id for r in codes.candidates(coded, "id", query.tolist()).collect()}
        found = [r.id for r in codes.knn_search_codes(coded, "id", "v", query.tolist(), 10).collect()]
        assert len(near) < 0.2 * 3000 and set(found) <= near and len(found) == 10
        hits += len(true & set(found))
    assert hits >= 45


def test_codes_of_few_and_equal_rows(spark):
    same = codes.with_codes(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(200)], "id long, v array<float>"), "v", 2)
    assert [r.id for r in codes.knn_search_codes(same, "id", "v", [1.0, 2.0], 3).collect()] == [0, 1, 2]
    assert codes.candidates(same, "id", [1.0, 2.0]).count() == 200  # none of equal estimates is left out
    assert codes.knn_search_codes(same.limit(0), "id", "v", [1.0, 2.0], 3).count() == 0


def dense(cells):
    names = sorted({r.word for r in cells})
    at = {w: i for i, w in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for r in cells:
        m[at[r.word], at[r.context]] = r.a
    return names, m


def test_pairs_and_information(spark):
    df = spark.createDataFrame([("a b c",), ("a b",), (None,), ("",), ("a",), ("a b c",), ("c c",)], "t string")
    got = {(r.word, r.context): r.n for r in co.pair_counts(df, "t", window=1, min_count=2).collect()}
    assert got == {("a", "b"): 3, ("b", "a"): 3, ("b", "c"): 2, ("c", "b"): 2, ("c", "c"): 2}
    info = {(r.word, r.context): r.a for r in co.mutual_information(co.pair_counts(df, "t", 1, 2)).collect()}
    assert info[("a", "b")] == pytest.approx(math.log(3 * 12 / (3 * 5)))
    assert info[("c", "c")] == pytest.approx(math.log(2 * 12 / (4 * 4)))
    assert co.word_vectors(df.limit(0), "t").count() == 0


def test_vectors_find_planted_neighbours(spark):
    """Words of one topic share contexts; two of them never meet in a text."""
    texts = []
    for i in range(600):
        topic = i % 3
        words = [f"t{topic}w{j}" for j in RNG.integers(0, 8, 12)]
        twin = ["left", "right"][i // 3 % 2] if topic == 1 else f"t{topic}w0"
        texts.append((" ".join([*words[:6], twin, *words[6:]]),))
    df = spark.createDataFrame(texts, "t string").repartition(3)
    vectors = co.word_vectors(df, "t", dimensions=8).cache()
    near = [r.word for r in wo.nearest_words(vectors, "word", "vector", "left", 9).collect()]
    assert "right" in near and all(w == "right" or w.startswith("t1") for w in near[:8])
    names, m = dense(co.mutual_information(co.pair_counts(df, "t")).collect())
    made = {r.word: r.vector for r in vectors.collect()}
    assert sorted(made) == names
    # the strongest directions are those of the whole decomposition
    values = np.linalg.svd(m, compute_uv=False)
    lengths = np.linalg.norm(np.array([made[w] for w in names]), axis=0) ** 2
    assert np.allclose(lengths[:3], values[:3], rtol=0.02)


def test_stored_sketches_add_up(spark, monkeypatch):
    path = scratch_path(spark, "sketches-test")

    def load(first, n, year):
        return spark.range(first, first + n).select(F.col("id").alias("k"), F.lit(year).cast("int").alias("annee"))

    sketches.add_load(load(0, 5000, 2001), path, "one", F.col("k"))
    sketches.add_load(load(2500, 5000, 2001).unionByName(load(0, 300, None)), path, "two", F.col("k"))
    sketches.add_load(load(2500, 5000, 2001), path, "two", F.col("k"))  # again: nothing changes
    got = {r.annee: (r.documents, r.distinct_keys) for r in sketches.stored_by_year(spark, path).collect()}
    assert got[2001][0] == 10_000 and abs(got[2001][1] - 7500) < 0.05 * 7500
    assert got[None][0] == 300 and abs(got[None][1] - 300) < 15
    total = sketches.stored_total(spark, path).first()
    assert total.documents == 10_300 and abs(total.distinct_keys - 7500) < 0.05 * 7500
    assert sketches.stored_total(spark, path, [1999]).first()[0] == 0
    # a stored table is one row per load and year
    assert table.read_table(spark, path, sketches.COUNTS).count() == 3


def test_semantic_search_takes_a_text(spark):
    df = spark.createDataFrame(
        [(1, "le budget de la France"), (2, "la pêche en mer"), (3, None), (4, ""), (5, "le budget")], "id long, t string")
    coded = vo.embed_texts(df, "t")
    assert [r.id for r in vo.semantic_search(coded, "id", "texte_embedding", "Budget !", 2).collect()] == [5, 1]
    assert [r.id for r in vo.semantic_search(coded, "id", "texte_embedding", "budget", 2, F.col("id") < 3).collect()][0] == 1
    assert vo.semantic_search(coded, "id", "texte_embedding", "", 2).count() == 0


def test_series_of_a_word(spark):
    texts = spark.createDataFrame([(1, "la paix"), (2, "la guerre"), (3, "paix"), (4, None)], "id long, t string")
    dates = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id long, g string").withColumn("d", F.to_date(F.lit("2020-01-02")))
    words = {"very_negative": (), "negative": ("guerre",), "positive": ("paix",), "very_positive": ()}
    day = analyses.word_sentiment_series(texts, dates, "id", "t", "d", "paix", None, "token", words).first()
    assert day["count"] == 2 and day["mean"] > 0
    groups = analyses.word_sentiment_series(texts, dates, "id", "t", "d", None, "g", "token", words).collect()
    assert {r.g: r["count"] for r in groups} == {"x": 2, "y": 1}


def test_first_seen_vectors_are_the_stored_ones(spark, tmp_path):
    """The registered query meets the texts with the embeddings table, whose vectors it returns."""
    texts = [(1, "un deux"), (2, "deux trois"), (2, "deux trois"), (3, "quatre")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    vectors = [(1, [0.5, 0.25]), (2, [1.0, 2.0]), (9, [7.0, 7.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = QUERIES["first_seen_vector"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in found.collect()) == [("deux", 1, 0.75), ("trois", 2, 3.0), ("un", 1, 0.75)]


def test_codes_are_computed_a_few_vectors_at_a_time(spark, monkeypatch):
    """As wide as one slice, or in slices, codes and estimates are the same."""
    vectors = RNG.normal(size=(200, 6)).tolist()
    rows = [(i, v if i % 9 else None) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "k int, v array<double>").coalesce(1)

    def found():
        coded = codes.with_codes(df, "v", 6)
        near = codes.estimates(coded, "k", vectors[0])
        return {r.k: r.code for r in coded.collect()}, {r.k: round(r.estimate, 4) for r in near.collect()}

    whole = found()
    monkeypatch.setattr(codes, "ROWS_AT_ONCE", 7)
    assert found() == whole and sum(c is None for c in whole[0].values()) == 23
    planes, seen = codes.axes(6), np.array(vectors)
    assert all(c is None or c == np.packbits(seen[k] @ planes.T > 0).tobytes() for k, c in whole[0].items())


def test_pairs_move_once_and_count_both_directions(spark):
    """Pairs of words are counted in one exchange; a word beside itself counts twice."""
    df = spark.createDataFrame([(1, "a b a a"), (2, "b a c"), (3, "c b"), (4, "c x"), (5, None)], "id int, t string")
    counts = co.pair_counts(df, "t", window=2, min_count=3)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("BroadcastExchange") == 2
    got = {(r.word, r.context): r.n for r in counts.collect()}
    assert got == {("a", "b"): 4, ("b", "a"): 4, ("a", "a"): 4, ("a", "c"): 1, ("c", "a"): 1, ("b", "c"): 2, ("c", "b"): 2}
    found = {(r.word, r.context): r.a for r in co.mutual_information(counts).collect()}
    margins = {w: sum(n for (x, _), n in got.items() if x == w) for w in "abc"}
    want = {k: math.log(n * sum(got.values()) / (margins[k[0]] * margins[k[1]])) for k, n in got.items()}
    assert found == pytest.approx({k: a for k, a in want.items() if a > 0})


def test_information_of_numbered_words_makes_no_rows_of_the_vocabulary(spark):
    """The same cells as from words, without a join whose rows the driver holds and sends."""
    texts = [(" ".join(f"w{j}" for j in RNG_NUMBERED.geometric(0.2, 40)),) for _ in range(30)]
    df = spark.createDataFrame([*texts, (None,), ("",), ("w1",), ("once w1 w1",)], "t string").repartition(3)
    words = co.known(df, "t", 3)
    counts = co.pair_counts(df, "t", 4, 3, words, numbered=True)
    margins = co.pair_margins(df, "t", 4, 3, words, numbered=True)
    found = co.mutual_information(counts, margins, words)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "LocalTableScan" not in plan and plan.count("Exchange hashpartitioning") == 1
    want = co.mutual_information(co.pair_counts(df, "t", 4, 3, words), co.pair_margins(df, "t", 4, 3, words))
    cells = [{(r.word, r.context): r.a for r in x.collect()} for x in (found, want)]
    assert cells[0] == pytest.approx(cells[1]) and cells[0] and found.count() == len(cells[0])
    assert found.dtypes == want.dtypes
    nothing = co.known(df.limit(0), "t", 3)
    assert co.mutual_information(co.pair_counts(df.limit(0), "t", 4, 3, nothing, numbered=True),
                                 co.pair_margins(df.limit(0), "t", 4, 3, nothing, numbered=True), nothing).count() == 0


def test_margins_come_from_the_texts(spark, monkeypatch):
    """Margins are the sums of the counts, without a pair in any exchange; stretches and parts
    change nothing."""
    texts = [(" ".join(f"w{j}" for j in RNG.geometric(0.2, 40)),) for _ in range(30)]
    df = spark.createDataFrame([*texts, (None,), ("",), ("w1",), ("once w1 w1",)], "t string").repartition(3)
    counts = {(r.word, r.context): r.n for r in co.pair_counts(df, "t", 4, 3).collect()}
    monkeypatch.setattr(co, "PAIRS", 500)
    monkeypatch.setattr(co, "PLACES", 11)
    cut = co.pair_counts(df, "t", 4, 3)
    assert {(r.word, r.context): r.n for r in cut.collect()} == counts and cut.count() == len(counts)
    sums = {}
    for (word, _), n in counts.items():
        sums[word] = sums.get(word, 0) + n
    margins = co.pair_margins(df, "t", 4, 3)
    assert {r.word: r.m for r in margins.collect()} == sums and not any(w == "once" for w in sums)
    known = co.mutual_information(cut, margins)
    assert known._jdf.queryExecution().executedPlan().toString().count("FlatMapGroupsInArrow") == 1
    found = [{(r.word, r.context): r.a for r in x.collect()} for x in (known, co.mutual_information(cut))]
    assert found[0] == pytest.approx(found[1]) and found[0]
