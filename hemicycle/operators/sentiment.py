"""Five-class sentiment scoring: a lexicon in native expressions, or any model in tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hemicycle.functions import scores as sc
from hemicycle.functions import text as tx
from hemicycle.operators import search
from hemicycle.schemas import CLASSES

# Default lexicon, our own choice of common opinion words: one list per class (neutral has none:
# it is the base). Any other lexicon of this shape can be given.
LEXICON: dict[str, tuple[str, ...]] = {
    "very_negative": (
        "abject", "abjecte", "abominable", "affreux", "affreuse", "atroce", "calamiteux",
        "calamiteuse", "cruel", "cruelle", "effroyable", "exécrable", "haine", "horrible",
        "ignoble", "indigne", "infâme", "insupportable", "intolérable", "lamentable", "monstrueux",
        "monstrueuse", "désastre", "honte", "scandale", "odieux", "odieuse", "ruine", "tragique",
        "appalling", "atrocious", "dreadful", "horrendous",
    ),
    "negative": (
        "absurde", "bad", "crise", "échec", "mauvais", "mauvaise", "danger", "dangereux",
        "dangereuse", "déception", "décevant", "défaut", "déplorable", "difficile", "dommage",
        "erreur", "faible", "faute", "grave", "hélas", "injuste", "insuffisant", "insuffisante",
        "inutile", "manque", "menace", "perte", "peur", "pire", "regrette", "retard", "risque",
        "triste", "flawed", "poor", "unfair", "weak",
    ),
    "positive": (
        "accord", "bon", "bonne", "good", "utile", "agréable", "amélioration", "améliorer",
        "avantage", "clair", "claire", "confiance", "content", "efficace", "espoir", "facile",
        "gagner", "heureux", "heureuse", "intéressant", "intéressante", "juste", "merci", "mieux",
        "pertinent", "pertinente", "réussi", "réussite", "solide", "solution", "succès", "clear",
        "fair", "helpful", "pleasant", "useful",
    ),
    "very_positive": (
        "admirable", "excellent", "excellente", "exceptionnel", "magnifique", "brillant",
        "brillante", "éblouissant", "enthousiasme", "exemplaire", "extraordinaire", "fabuleux",
        "fantastique", "félicitations", "génial", "géniale", "grandiose", "idéal", "idéale",
        "incomparable", "inestimable", "magistral", "magistrale", "merveilleux", "merveilleuse",
        "parfait", "parfaite", "sublime", "superbe", "triomphe", "amazing", "brilliant",
        "outstanding", "superb",
    ),
}
# Logit added per hit of the class, and the base logit of the neutral class.
HIT_WEIGHT = 6.0
NEUTRAL_BASE = 1.0


def lexicon_hits(tokens: Column, words: tuple[str, ...]) -> Column:
    return F.size(F.filter(tokens, lambda t: t.isin(*words)))


def score_sentiment(
    df: DataFrame, text: str, lexicon: dict[str, tuple[str, ...]] | None = None
) -> DataFrame:
    """Add the five class probabilities from a lexicon; the whole text counts.

    Logit of a class = weight * hits per square root of the text's words, so that long
    texts do not saturate; the neutral class has a constant logit.
    """
    chosen = lexicon or LEXICON
    bound = search.bind(df, "_tokens", tx.tokenize(F.col(text)))
    scale = F.lit(HIT_WEIGHT) / F.sqrt(F.greatest(F.size("_tokens"), F.lit(1)).cast("double"))
    # hits first, in one pass per class; the arithmetic then stays in generated code
    bound = bound.select(
        "*",
        *[lexicon_hits(F.col("_tokens"), tuple(chosen.get(c, ()))).alias(f"_h_{c}")
          if chosen.get(c) else F.lit(0).alias(f"_h_{c}") for c in CLASSES],
    ).withColumn("_scale", scale)
    logits = [
        F.col(f"_h_{c}") * F.col("_scale") + F.lit(NEUTRAL_BASE if c == "neutral" else 0.0)
        for c in CLASSES
    ]
    probabilities = sc.softmax_columns(logits)
    return bound.select(*df.columns, *[p.alias(c) for p, c in zip(probabilities, CLASSES)])


def sentiment_index(df: DataFrame, text: str, lexicon: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Add ``score``, the 0..4 index of the lexicon's probabilities."""
    scored = score_sentiment(df, text, lexicon)
    return scored.select(*df.columns, sc.sentiment_index_0_4().alias("score"))


Scorer = Callable[[list[str]], "list[list[float]]"]


def score_with_model(
    df: DataFrame, text: str, load: Callable[[], Scorer], batch_size: int = 32
) -> DataFrame:
    """The same columns from a model. ``load`` runs once per task and returns a scorer
    that turns a list of texts into five probabilities each; NULL is scored as ''."""
    classes = list(CLASSES)
    schema = T.StructType(
        df.schema.fields + [T.StructField(c, T.DoubleType()) for c in classes]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for batch in batches:
            texts = batch[text].fillna("").tolist()
            rows: list = []
            for at in range(0, len(texts), batch_size):
                rows.extend(scorer(texts[at : at + batch_size]))
            scored = pd.DataFrame(rows, columns=classes, index=batch.index, dtype="float64")
            yield pd.concat([batch, scored], axis=1)

    return df.mapInPandas(run, schema)
