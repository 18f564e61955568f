"""The words of a corpus by number, the most frequent first."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def known_words(rows: DataFrame, tokens: str, min_count: int) -> pa.Table:
    """(word, c) of the words that occur ``min_count`` times, on the driver."""
    return rows.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count("*").alias("c")).where(
        F.col("c") >= min_count).orderBy(F.desc("c"), "word").toArrow()


def placed(tokens: pa.Array, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of every token in a column of lists: the word's number, -1 where there is none, and the row."""
    spelled = tokens.flatten().dictionary_encode()
    places = pc.index_in(spelled.dictionary, value_set=words).fill_null(-1).to_numpy(zero_copy_only=False)
    ids = places[spelled.indices.to_numpy(zero_copy_only=False)] if len(spelled) else np.zeros(0, np.int32)
    return ids, np.repeat(np.arange(len(tokens)), tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
