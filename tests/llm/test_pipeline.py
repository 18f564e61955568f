"""The pipeline: each stage judged on its own input."""

import time
from collections import Counter

import pyarrow as pa
import pytest

import corpus_pipeline
from hemicycle.llm import language, packing
from hemicycle.llm.common import cut

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_their_promises(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs.collect()
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, FOLDER))
        assert docs.columns == columns, name
        kept.append(docs.collect())
    languages, lines, single, mixed = kept
    assert len(languages) >= 0.97 * len(before)
    assert sum(r.lang == {b.doc_id: b.lang for b in before}[r.doc_id] for r in languages) >= 0.97 * len(languages)
    assert Counter(r.doc_id for r in lines) == Counter(r.doc_id for r in languages)
    assert all(r.n_chars == len(r.text) for r in lines)
    texts = Counter(r.text for r in single)
    assert max(texts.values()) == 1 and set(texts) <= {r.text for r in lines}
    gone = {r.doc_id for r in lines} - {r.doc_id for r in single}
    short = {r.doc_id for r in lines if len(r.text.split()) < 5}
    assert len(gone - short) <= 0.2 * len(lines)  # the clean majority stays
    assert {r.doc_id for r in single} == {r.doc_id for r in mixed}
    assert max(Counter(r.doc_id for r in mixed).values()) == 2
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in mixed)


def test_language_stage_judges_as_the_operator_does(spark):
    """Markup and address of pages count in the stage too."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    judged = language.identify_documents(docs, pages).where("kept").collect()
    kept = corpus_pipeline.language_id(spark, docs, FOLDER).collect()
    assert Counter((r.doc_id, r.lang) for r in kept) == Counter((r.doc_id, r.language) for r in judged)


def test_declared_language_decides_mixed_texts(spark, tmp_path):
    en, de = "the house and the tree are over there ", "das haus und der baum sind dort drüben "
    rows = [(i, (en if i % 2 else de) * 5, "en" if i % 2 else "de", "s", 1) for i in range(400)]
    mixed = range(1000, 1040)
    rows += [(i, "tree baum are sind " * 3, "en" if i % 2 else "de", "s", 1) for i in mixed]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    shown = [*range(400), *mixed]
    said = ["en" if i % 2 else "de" for i in shown]
    spark.createDataFrame(
        [(i, f"http://h{i % 7}.com/{i}.html", f"<html lang='{x}'>") for i, x in zip(shown, said)],
        "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    kept = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, docs, str(tmp_path)).collect()}
    assert [kept[i] for i in mixed] == ["en" if i % 2 else "de" for i in mixed]


def test_run_gives_all_rows(spark):
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


def test_each_stage_prepares_its_session(spark, monkeypatch):
    """Also a stage run by itself hands rows to Python workers by bytes."""
    class Prepared(Exception):
        pass

    def prepare(session):
        raise Prepared

    monkeypatch.setattr(corpus_pipeline, "prepare", prepare)
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        with pytest.raises(Prepared):
            stage(spark, docs, FOLDER)


def test_workers_forget_chunks_after_packing(spark):
    """Spark reuses its workers; those of other stages do not hold what packing remembered."""
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(40)], "doc_id long, text string")

    def holders():
        def run(batches):
            import sys

            for batch in batches:
                held = "_chunk_encoder" in vars(sys.modules.get("tokenizers", sys))
                time.sleep(0.2)  # so that each task has a worker of its own
                yield pa.RecordBatch.from_arrays([pa.array([held] * batch.num_rows)], ["held"])

        return spark.range(0, 4, 1, 4).mapInArrow(run, "held boolean").where("held").count()

    packing.cut_pieces(docs, corpus_pipeline.TOKENIZER).count()
    time.sleep(packing.IDLE_SECONDS + 1)
    assert holders() == 0
