import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from hemicycle.functions import dates as dt
from hemicycle.functions import files as fl
from hemicycle.functions import french
from hemicycle.functions import scores as sc
from hemicycle.functions import text as tx
from hemicycle.functions import vectors as vx


def apply(spark, rows, schema, *columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.select(*columns).collect()]


TEXTS = [None, "", "  a  b\n\tc  ", "L'été à 3, x_y !", "d’or\x1ffin", "un  deux", "  \n"]


def test_cleaning_follows_python(spark):
    got = apply(spark, [(t,) for t in TEXTS], "t string", tx.clean_text(F.col("t")))
    assert got == [re.sub(r"\s+", " ", t or "").strip() for t in TEXTS]
    blank = apply(spark, [(t,) for t in TEXTS], "t string", tx.is_blank(F.col("t")))
    assert blank == [not (t or "").strip() for t in TEXTS]


def test_tokens_follow_python(spark):
    want = [re.sub(r"[^\w\s]", "", (t or "").lower()).split() for t in TEXTS]
    assert apply(spark, [(t,) for t in TEXTS], "t string", tx.tokenize(F.col("t"))) == want
    counts = apply(spark, [(t,) for t in TEXTS], "t string", tx.word_count_ws(F.col("t")))
    assert counts == [len((t or "").split()) for t in TEXTS]
    assert apply(spark, [("un  deux ",)], "t string", tx.word_count_space(F.col("t"))) == [4]


@pytest.mark.parametrize("text, name, generic, want", [
    ("M. Jean Dupont. Bonjour.", "M. Jean Dupont", True, "Bonjour."),
    ("m. jean dupont Bonjour.", "M. Jean Dupont", True, "Bonjour."),
    ("\n   M. Jean Dupont.\n  Bonjour.", "M. Jean Dupont.", True, "Bonjour."),
    ("Mme la ministre. Merci.", None, True, "Merci."),
    ("Mme la ministre. Merci.", None, False, "Mme la ministre. Merci."),
    ("Sans nom", "X", True, "Sans nom"),
    (None, "X", True, ""),
    ("A+B (x). Texte", "A+B (x)", True, "Texte"),
])
def test_speaker_prefix(spark, text, name, generic, want):
    column = tx.strip_speaker_prefix(F.col("t"), F.col("n"), generic)
    assert apply(spark, [(text, name)], "t string, n string", column) == [want]


def test_indented_name_stays_without_stripping_first(spark):
    column = tx.strip_speaker_prefix(F.col("t"), F.lit("M. A."), generic=False, strip_first=False)
    assert apply(spark, [("  M. A. Oui",)], "t string", column) == ["M. A. Oui"]


def test_clean_speaker(spark):
    names = [" M. Paul Durand. ", "Mme Anne, .", "M.", "Jean M. Petit", "Mme", "a ., b.,"]
    got = apply(spark, [(n,) for n in names], "n string", tx.clean_speaker(F.col("n")))
    assert got == ["Paul Durand", "Anne", "", "Jean M. Petit", "", "a ., b"]


def test_roles(spark):
    names = ["M. le président.", "Mme la ministre", "M. le secrétaire d'État", "M. X", "", None,
             "M. le ministre, président"]
    got = apply(spark, [(n,) for n in names], "n string", tx.classify_role(F.col("n")))
    assert got == ["Président", "Ministre", "Secrétaire", "Député", None, None, "Président"]


def test_excerpt_and_preview(spark):
    text = "x" * 60 + "Mot" + "y" * 200
    got = apply(spark, [(text,), ("Mot au début",), ("rien",)], "t string", tx.kwic_excerpt(F.col("t"), "mot"))
    assert got == ["..." + text[10:160] + "...", "...Mot au début...", None]
    assert apply(spark, [("abc",)], "t string", tx.preview(F.col("t"), 2)) == ["ab..."]


def test_dates(spark):
    texts = ["Mercredi-22-05-Mai-2013", "Jeudi-3-4-Avril-2018", "2018-04-12", "x", None, "a-b-c", "Jour-31-02-F-2019"]
    got = apply(spark, [(t,) for t in texts], "t string", dt.parse_an_date(F.col("t")))
    assert got == [datetime.date(2013, 5, 22), datetime.date(2018, 4, 3), datetime.date(2018, 4, 12),
                   None, None, None, None]


def test_file_names(spark):
    paths = ["data/raw/2018/AN_2018037.taz", "data/raw/AN_2019002.taz", "data/AN_20.taz", "x/12345/AN_2020",
             "file:/a/2021/b.taz", "data/raw/2019/AN_20191001.taz"]
    got = apply(spark, [(p,) for p in paths], "p string", fl.file_year(F.col("p")),
                fl.issue_year(F.col("p")), fl.issue_number(F.col("p")))
    assert got == [("2018", 2018, 37), ("2019", 2019, 2), ("unknown", 20, None), ("unknown", 2020, None),
                   ("2021", None, None), ("2019", 2019, 1001)]


def test_probabilities_are_formatted_like_python(spark):
    rng = random.Random(3)
    values = [i / 100000 for i in range(0, 100000, 5)] + [rng.random() for _ in range(2000)] + [
        0.0, 1.0, 0.15625, 0.03125, 0.99996, 2.0**-20, i / 64 if (i := 7) else 0]
    got = apply(spark, [(v,) for v in values], "p double", sc.format_prob(F.col("p")))
    assert got == [f"{v:.4f}" for v in values]


def test_softmax_and_vectors(spark):
    v = [3.0, 4.0, 0.0]
    got = apply(spark, [(v, [0.0, 0.0, 0.0])], "v array<float>, z array<float>",
                vx.l2_normalise(F.col("v")), vx.l2_normalise(F.col("z")),
                vx.cosine(F.col("v"), F.col("z")), vx.cosine(F.col("v"), F.col("v")),
                vx.cosine_to(F.col("v"), [4.0, 3.0, 0.0]), sc.softmax(F.array(F.lit(1000.0), F.lit(1000.0))))
    assert got[0][:2] == (pytest.approx([0.6, 0.8, 0.0]), [0.0, 0.0, 0.0])
    assert got[0][2:5] == (0.0, pytest.approx(1.0), pytest.approx(0.96))
    assert got[0][5] == [0.5, 0.5]
    odd = apply(spark, [([1.0, 0.0],), (None,), ([1.0],), ([0.0, 2.0],), ([0.0, 0.0],)], "v array<double>",
                vx.cosine_to(F.col("v"), [0.0, 5.0]))
    assert odd == [0.0, None, 0.0, 1.0, 0.0]


def test_json_list(spark):
    got = apply(spark, [("[1]",), ('{"k": [1]}',), ("not json",), (None,)], "j string",
                tx.json_list_test(F.col("j")))
    assert got[:2] == [True, False] and not got[2] and got[3] is None


def test_french_terms(spark):
    texts = ["L’immigration des migrants et d'un migrant", "Jusqu'à l'égalité, les chevaux", None]
    words = apply(spark, [(t,) for t in texts], "t string", french.french_words(F.col("t")))
    assert words == [["immigration", "migrants", "migrant"], ["égalité", "chevaux"], []]
    terms = apply(spark, [(t,) for t in texts], "t string", french.french_terms(F.col("t")))
    assert terms[0][1] == terms[0][2] and terms[1][1] == french.light_stem("cheval")
    assert terms[1][0] == "egalit" and terms[2] == []


def test_digest_tells_null_from_empty(spark):
    got = apply(spark, [(None, "a"), ("", "a"), ("a", None)], "a string, b string",
                F.hex(tx.digest(F.col("a"), F.col("b"))))
    assert len(set(got)) == 3
