"""French analysis and span search against independent, written-out versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from hemicycle.functions import french
from hemicycle.operators import search, topk

# word and stem, as published with the algorithm's implementations
PAIRS = """chevaux cheval, cheval cheval, hiboux hibou, chantés chant, chanter chant, chante chant, chant chant,
baronnes baron, barons baron, peaux peau, anneaux aneau, anneau aneau, neveux neveu, affreux afreu, affreuse afreu,
investissement investi, investir investi, assourdissant asourdi, assourdir asourdi, pratiquement pratiqu,
pratique pratiqu, administrativement administratif, administratif administratif, justificatrice justifi,
justificateur justifi, justifier justifi, éducatrice eduqu, éducateur eduqu, éduquer eduqu, communicateur comuniqu,
communiquer comuniqu, accompagnatrice acompagn, accompagnateur acompagn, administrateur administr,
administrer administr, productrice product, producteur product, acheteuse achet, acheteur achet, planteur plant,
plante plant, poreuse poreu, poreux poreu, plieuse plieu, bijoutière bijouti, bijoutier bijouti, caissière caisi,
caissier caisi, abrasive abrasif, abrasif abrasif, folle fou, fou fou, personnelle person, personne person,
complète complet, complet complet, aromatique aromat, faiblesse faibl, faible faibl, patinage patin, patin patin,
sonorisation sono, sonore sonor, ritualisation rituel, rituel rituel, nomination nomin, disposition dispos,
dispose dispos"""


def random_words(n):
    rng = random.Random(1)
    ends = [e for _, rules in french.STEPS for e, _, _ in rules] + ["ie", "er", "e", "ee", "r", "s", "x", "eux"]
    return sorted({
        "".join(rng.choice("abcdefiloqurtuvéèêàçnmaeiu1") for _ in range(rng.randrange(1, 9)))
        + "".join(rng.choice(ends) for _ in range(rng.randrange(3))) for _ in range(n)})


def test_published_pairs(spark):
    pairs = [tuple(p.split()) for p in PAIRS.replace("\n", " ").split(", ")]
    rows = spark.createDataFrame(pairs, "word string, stem string")
    assert all(french.light_stem(w) == s for w, s in pairs)
    assert rows.where(french.stem(F.col("word")) != F.col("stem")).count() == 0


def test_native_stems_equal_those_of_query_words(spark):
    words = [*random_words(20_000), "", "a", "été", "ss", "œuvre", "naïve", "e", "r", "eee"]
    got = {r.w: r.s for r in spark.createDataFrame([(w,) for w in words], "w string").select(
        "w", french.stem(F.col("w")).alias("s")).collect()}
    assert got == {w: french.light_stem(w) for w in words}


def test_every_word_begins_as_its_stem_allows():
    for word in random_words(50_000):
        assert re.match(french.may_stem_to(french.light_stem(word)), word), word


def test_query_tokens_equal_text_tokens(spark):
    texts = ["L'immigration d’État, aujourd'hui", "jusqu'à l''eau 'l'eau x_y", "qu'l'on", "l' eau'", "ÉTÉ 2020!", "", "''"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(french.french_tokens(F.col("t"))).collect()
    assert [r[0] for r in rows] == [french.query_tokens(t) for t in texts]


def brute_spans(text, query):
    tokens = french.query_tokens(text)
    words = [w for w in french.query_tokens(query)]
    kept = [i for i, w in enumerate(words) if w not in french.STOP_WORDS]
    words = [None if i not in kept else french.light_stem(w) for i, w in enumerate(words)][kept[0]: kept[-1] + 1]
    return [(i, i + len(words) - 1) for i in range(len(tokens) - len(words) + 1)
            if all(w is None or french.light_stem(tokens[i + k]) == w for k, w in enumerate(words))]


def brute_gap(text, a, b):
    gaps = [max(y[0] - x[1], x[0] - y[1]) - 1 for x in brute_spans(text, a) for y in brute_spans(text, b)
            if y[0] > x[1] or x[0] > y[1]]
    return min(gaps, default=None)


def test_phrases_near_each_other(spark):
    df = spark.createDataFrame([
        (1, "La sécurité sociale protège les enfants."), (2, "La sécurité est sociale. Les enfants"), (3, None),
        (4, "L'enfant, dit-on, relève de la Sécurité Sociale"), (5, "Sécurité sociale"), (6, "Le droit du vote des enfants")],
        "id int, t string")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(search.match_proximity(df, "t", "sécurité sociale", "enfants")) == [1, 4]
    assert ids(search.match_proximity(df, "t", "sécurité sociale", "enfants", 2)) == [1]
    assert ids(search.match_proximity(df, "t", "droit de vote", "enfant")) == [6]  # the place of "de" is open
    assert ids(search.match_proximity(df, "t", "sécurité sociale", "enfants", mode="token")) == [1]
    with pytest.raises(ValueError, match="no word"):
        search.match_proximity(df, "t", "les", "enfants")


@pytest.mark.parametrize("a,b", [("mi", "na"), ("mi na", "na"), ("mi mi", "mi"), ("na pu mi", "pu na"), ("pu de mi", "na"), ("mi", "mi")])
def test_least_gap_equals_all_pairs(spark, a, b):
    rng = random.Random(len(a) + len(b))
    rows = [(i, " ".join(rng.choice(["mi", "na", "Pu", "de", "zu"]) for _ in range(rng.randrange(25)))) for i in range(250)]
    got = {r.id: r.least_gap for r in search.proximity(spark.createDataFrame(rows, "id int, t string"), "t", a, b).collect()}
    assert got == {i: brute_gap(t, a, b) for i, t in rows if brute_gap(t, a, b) is not None}


def test_near_word_pairs_with_phrase_and_stems(spark):
    df = spark.createDataFrame([(1, "les chevaux noirs courent vite"), (2, "chevaux blancs, noirs et vites"), (3, "cheval noir")], "id int, t string")
    words = spark.createDataFrame([("vite", 0.9), ("courir", 0.8), ("rien", 0.1)], "word string, score double")
    pairs = {tuple(r) for r in search.near_word_pairs(df, words, "id", "t", "cheval noir", 1).collect()}
    assert pairs == {("vite", 1)}
    counts = {r.word: r.paragraphs for r in search.similar_words_paragraphs(df, words, "id", "t", "noir", 2).collect()}
    assert counts == {"vite": 2, "courir": 0, "rien": 0}


def test_match_word_takes_candidates_as_whole_tokens(spark):
    """A match does not depend on taking candidates out of the text first."""
    rng = random.Random(9)
    pieces = ["l'", "d’", "qu'", "'", "’", " ", "-", "migrant", "migrants", "aujourd'", "hui", "mi", "grant", "immigration", ". "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for query in ("migrant", "hui aujourd'hui", "immigrations", "mi"):
        got = {r.id for r in search.match_word(df, "t", query).collect()}
        wanted = {french.light_stem(w) for w in french.query_tokens(query)}
        assert got == {i for i, t in enumerate(texts) if wanted & {french.light_stem(w) for w in french.query_tokens(t)}}


def test_terms_of_a_query_are_literals(spark):
    df = spark.createDataFrame([("x",)], "t string")
    plan = search.match_word(df, "t", "enfants")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and plan.count("Filter") == 1


def test_theme_hits_leave_the_text_behind(spark):
    df = spark.createDataFrame([(1, "La sécurité des violences"), (2, "rien"), (3, None)], "id int, t string")
    hits = topk.theme_hits(df, topk.THEMES, "t")
    assert hits.columns == ["id", "theme"]
    assert sorted(tuple(r) for r in hits.collect()) == [(1, "sécurité"), (1, "violence")]
    counted = search.term_counts(df.unionByName(spark.createDataFrame([(4, "violent violence Violences")], df.schema)), "id", "t")
    assert {(r.id, r.term, r.n) for r in counted.collect()} >= {(4, french.light_stem("violence"), 2)}
