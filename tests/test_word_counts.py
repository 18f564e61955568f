"""Words counted inside their rows; likely words of a search term."""

import random
from collections import Counter

from pyspark.sql import functions as F

from hemicycle.functions import french
from hemicycle.functions import text as tx
from hemicycle.operators import search


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_of_rows_do_not_travel(spark):
    rows = [(1, "b a b"), (2, "a"), (3, None), (4, ""), (None, "c c")]
    counts = search.word_counts(spark.createDataFrame(rows, "id long, t string"), "id", tx.tokenize(F.col("t")))
    assert "Exchange" not in plan(counts)
    assert sorted(map(str, map(tuple, counts.collect()))) == sorted(
        map(str, [(1, "a", 1), (1, "b", 2), (2, "a", 1), (None, "c", 2)]))


def test_rows_of_one_key_are_counted_together(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.choice([None, "k1", "k2", f"u{i}"]), " ".join(rng.choices("abcde", k=rng.randrange(6)))) for i in range(60)]
    rows += [(None, None), ("k1", None)]
    df = spark.createDataFrame(rows, "id string, t string").repartition(3)
    want = Counter((k, w) for k, t in rows for w in (t or "").split())
    for most in (search.BROADCAST_KEYS, 0):
        monkeypatch.setattr(search, "BROADCAST_KEYS", most)
        got = search.word_counts(df, "id", tx.tokenize(F.col("t")))
        assert got.dtypes == [("id", "string"), ("word", "string"), ("n", "bigint")]
        found = [tuple(r) for r in got.collect()]
        assert len(found) == len(want) and {(k, w): n for k, w, n in found} == want


def test_first_letters_of_a_stem_cover_its_words():
    rng = random.Random(7)
    endings = [old for _, rules in french.STEPS for old, _, _ in rules] + ["", "e", "er", "ie", "eer", "s", "x"]
    letters = "abcdefghilmnoprstuv" + french.ACCENTS[0]
    for _ in range(20_000):
        word = "".join(rng.choices(letters, k=rng.randrange(0, 6))) + rng.choice(endings) + rng.choice(["", "s", "x", "e"])
        stem = french.light_stem(word)
        if word and stem:
            assert word[0] in french.may_begin_with(stem), (word, stem)


def test_likely_words_of_a_text_are_stemmed_once(spark):
    """The first word's test of a stem is made on distinct words, whose places are then looked up."""
    tokens = "inns in îns inter inès in the in".split()
    df = spark.createDataFrame([(tokens,), ([],), (["x"],)], "t array<string>")
    for query in ("in", "in thes", "anement"):
        wanted = search.term(query)
        made = search.positions(F.col("t"), wanted)
        assert "array_distinct" in df.select(made)._jdf.queryExecution().analyzed().toString()
        want = [i + 1 for i in range(len(tokens)) if all(
            i + p < len(tokens) and french.light_stem(tokens[i + p]) == w for w, p in zip(wanted.words, wanted.places))]
        assert [r[0] for r in df.select(made).collect()] == [want, [], []]


def test_texts_with_and_without_apostrophes(spark):
    rows = [("L’Arbre d'or l'l'eau ’’ qu", ), ("sans signe",), (None,), ("'l’été''",)]
    found = spark.createDataFrame(rows, "t string").select(french.french_tokens(F.col("t"))).collect()
    assert [r[0] for r in found] == [french.query_tokens(t or "") for t, in rows]
