"""Whole analyses, from the table of paragraphs to a series: each is one Spark plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from hemicycle.functions import scores as sc
from hemicycle.operators import aggregates, search, sentiment, vectors


def word_sentiment(df: DataFrame, key: str, text: str, word: str | None, mode: str = search.FRENCH,
                   lexicon: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(key, five classes) of the paragraphs that contain a word (all of them without one). Texts
    are read, matched and scored in one stage; none of them travels."""
    hits = search.match_word(df.select(key, text), text, word, mode)
    return sentiment.score_sentiment(hits, text, lexicon).drop(text)


def word_sentiment_series(df: DataFrame, dates: DataFrame, key: str, text: str, date: str, word: str | None,
                          family: str | None = None, mode: str = search.FRENCH,
                          lexicon: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Mean sentiment per day (and per value of ``family``) of the paragraphs with a word.

    ``dates``: (key, date, family), one row per key. Only keys and classes meet it.
    """
    scored = word_sentiment(df, key, text, word, mode, lexicon).join(dates, key)
    if family is None:
        return aggregates.sentiment_daily(scored, date, sc.sentiment_score())
    return aggregates.sentiment_daily_group(scored, date, family, sc.sentiment_score())


def topic_centroids(df: DataFrame, text: str, year: str, vector: str, topic: str | None,
                    mode: str = search.FRENCH) -> DataFrame:
    """Mean vector per year of the paragraphs on a topic."""
    return vectors.vector_centroid(search.filter_topic(df.select(year, vector, text), text, topic, mode), year, vector)


def topic_drift(df: DataFrame, text: str, year: str, vector: str, topic: str | None,
                mode: str = search.FRENCH, from_first: bool = False) -> DataFrame:
    """How far a topic moved from year to year, or from its first year."""
    centroids = topic_centroids(df, text, year, vector, topic, mode)
    return vectors.drift_cumulative(centroids, year) if from_first else vectors.drift_year_to_year(centroids, year)
