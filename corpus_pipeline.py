"""A corpus pipeline: each stage applies one operator of ``hemicycle.llm`` to all documents
that the stage before it kept. The last stage returns packed sequences, the others documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hemicycle.llm import language, line_dedup, mixing, packing, simhash
from hemicycle.llm.common import cut
from hemicycle.llm.queries import TOKENIZER
from hemicycle.session import prepare

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def prepared(stage: Stage) -> Stage:
    """The stage in a session with the settings its operators rely on, also when run by itself:
    without them a Python worker is given rows by number and not by bytes."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(prepare(spark), docs, sf_dir)

    return run_stage


@prepared
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language, with ``lang`` set to it; their text, and markup and address
    of the pages that show them decide (the source, where no page does)."""
    return language.keep_identified(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet"))


@prepared
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier three-line windows; n_chars follows."""
    found = line_dedup.dedup_lines(docs)
    return found.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`")
                          for c in docs.columns])


@prepared
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return simhash.keep_one(docs)


@prepared
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by temperature mixing: none is lost, small sources repeat, at most
    twice."""
    drawn = mixing.draw(docs, mixing.plan_mix(docs), epoch="__epoch")
    return drawn.select(*[F.col(f"`{c}`") for c in docs.columns])


@prepared
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the drawn documents with their places in sequences of 2048 tokens."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("best_fit_packing", packed),
]

#: Models, SimHash and the tokenizer have no SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written before the next stage reads it."""
    docs = prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
