"""Word vectors: first-seen vectors, nearest words, Word2Vec models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemicycle.functions import text as tx
from hemicycle.functions import vectors as vx
from hemicycle.operators import search, skipgram


def first_seen(df: DataFrame, text: str, order: str) -> DataFrame:
    """(word, first): the order value of the first text containing each word."""
    words = df.select(order, F.explode(F.array_distinct(tx.tokenize(F.col(text)))).alias("word"))
    return words.groupBy("word").agg(F.min(order).alias("first_seen"))


def first_seen_vector(
    df: DataFrame, text: str, order: str, vector: str, stored: DataFrame | None = None
) -> DataFrame:
    """Vector of the first text containing each word.

    Only the order value is aggregated per word; the vector is joined afterwards, so it is
    not carried through the shuffle of all words. Vectors come from the texts' own rows, or
    from a table ``stored`` with the columns ``order`` and ``vector``: a text that occurs in
    several rows of ``df`` then gives no more than its stored vectors.
    """
    firsts = first_seen(df.where(F.col(vector).isNotNull()), text, order)
    vectors = (df if stored is None else stored).select(F.col(order).alias("first_seen"), vector)
    return firsts.join(vectors, "first_seen").select("word", "first_seen", vector)


def nearest_words(words: DataFrame, word: str, vector: str, target: str, n: int = 10) -> DataFrame:
    """The n words closest to ``target``; the word itself is left out by name."""
    query = words.where(F.col(word) == F.lit(target)).select(vector)
    return (
        words.where(F.col(word) != F.lit(target))
        .withColumn("_q", query.scalar())
        .where(F.col("_q").isNotNull())
        .withColumn("score", vx.cosine(F.col(vector), F.col("_q")))
        .select(word, "score")
        .orderBy(F.desc("score"), word).limit(n)
    )


@dataclass(frozen=True)
class WordModel:
    """A trained model; its vectors stay rows (word, vector)."""

    vectors: DataFrame

    def getVectors(self) -> DataFrame:
        return self.vectors.select("word", array_to_vector("vector").alias("vector"))

    def findSynonyms(self, word: str, n: int) -> DataFrame:
        """(word, similarity) of the n nearest words by cosine; the word has to be known."""
        if self.vectors.where(F.col("word") == F.lit(word)).isEmpty():
            raise ValueError(f"{word!r} is not in the vocabulary")
        return nearest_words(self.vectors, "word", "vector", word, n).withColumnRenamed("score", "similarity")


def train_word2vec(
    df: DataFrame, text: str, vector_size: int = 300, window: int = 6, min_count: int = 3,
    epochs: int = 10, seed: int = 42, partitions: int = 1,
) -> WordModel:
    """Skip-gram model over the non-blank texts. Training runs on ``partitions`` tasks, and on more,
    up to the cluster's cores, where there are many words for each (:mod:`skipgram`)."""
    rows = df.where(~tx.is_blank(F.col(text))).select(tx.tokenize(F.col(text)).alias("tokens"))
    return WordModel(skipgram.train(rows, "tokens", vector_size, window, min_count, epochs, seed, partitions))


def similar_words(model: WordModel, word: str, n: int = 10) -> DataFrame:
    """(word, score) of the model's n nearest words."""
    return model.findSynonyms(word, n).select("word", F.col("similarity").alias("score"))


def analyse_similar_words(
    df: DataFrame, model: WordModel, key: str, text: str, main: str, n: int = 20,
    slop: int = 20,
) -> DataFrame:
    """Paragraph counts for the model's n words nearest to ``main``."""
    return search.similar_words_paragraphs(df, similar_words(model, main, n), key, text, main, slop)
