"""Registered queries of this sub-package and the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hemicycle.llm import (
    ann, conversation_repair, fill_in_middle, host_rules, language, line_dedup, mixing, packing, simhash, suffix_dedup,
    topk, toxicity, url_filter,
)
from hemicycle.plans.registry import Tables

#: Vocabulary for packing; any other file of the same library can be given to the operator.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(build: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query("op1_topk_search", topk.SQL)
def op1(t: Tables) -> DataFrame:
    return topk.top_k(t.embeddings)


@query("op5_line_dedup", line_dedup.SQL)
def op5(t: Tables) -> DataFrame:
    return line_dedup.dedup_lines(t.documents.select("doc_id", "text"))


@query("op6_nearest_neighbours")
def op6(t: Tables) -> DataFrame:
    return ann.nearest(t.embeddings)


@query("op8_source_mixing", mixing.SQL)
def op8(t: Tables) -> DataFrame:
    return mixing.mix(t.documents)


@query("op9_url_filter", url_filter.SQL)
def op9(t: Tables) -> DataFrame:
    return url_filter.filter_urls(t.pages)


@query("op2_toxicity")
def op2(t: Tables) -> DataFrame:
    return toxicity.find_toxic(t.documents, t.labels)


@query("op3_language_id")
def op3(t: Tables) -> DataFrame:
    return language.identify_documents(t.documents, t.pages)


@query("op4_best_fit_packing")
def op4(t: Tables) -> DataFrame:
    return packing.pack(t.documents, TOKENIZER)


@query("op7_simhash_near_dedup")
def op7(t: Tables) -> DataFrame:
    return simhash.near_fingerprints(t.documents)


@query("op10_suffix_dedup")
def op10(t: Tables) -> DataFrame:
    return suffix_dedup.dedup_report(t.documents)


@query("op11_quality_rules", host_rules.SQL)
def op11(t: Tables) -> DataFrame:
    return host_rules.judge(t.documents)


@query("op12_fill_in_middle", fill_in_middle.SQL)
def op12(t: Tables) -> DataFrame:
    return fill_in_middle.digests(t.documents)


@query("op13_conversation_repair")
def op13(t: Tables) -> DataFrame:
    return conversation_repair.repair(t.conversations)
