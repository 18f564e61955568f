"""Skip-gram with negative sampling: neighbours, vocabulary, tasks."""

import numpy as np
import pytest

from hemicycle.operators import skipgram
from hemicycle.operators import words as wo

RNG = np.random.default_rng(5)


def corpus(spark, n=1200):
    """Words of one topic share contexts; left and right never meet in a text."""
    texts = []
    for i in range(n):
        words = [f"t{i % 3}w{j}" for j in RNG.integers(0, 8, 12)]
        twin = ["left", "right"][i // 3 % 2] if i % 3 == 1 else f"t{i % 3}w0"
        texts.append((" ".join([*words[:6], twin, *words[6:]]),))
    return spark.createDataFrame([*texts, (None,), ("",), ("rare rare",)], "t string").repartition(3)


def test_topics_are_learned_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(skipgram, "BLOCK", 64)  # several blocks of vectors
    model = wo.train_word2vec(corpus(spark), "t", vector_size=16, window=6, epochs=10, partitions=3)
    got = {r.word: np.array(r.vector) for r in model.getVectors().collect()}
    assert len(got) == 26 and "rare" not in got and all(len(v) == 16 for v in got.values())
    near = [r.word for r in wo.similar_words(model, "left", 9).collect()]
    assert "right" in near and all(w == "right" or w.startswith("t1") for w in near)
    for word in ("t0w3", "t2w5"):
        assert all(r.word.startswith(word[:2]) for r in wo.similar_words(model, word, 7).collect())


def test_a_large_corpus_gets_more_tasks_and_every_word(spark, monkeypatch):
    """Tasks follow the words to train, up to the cores; the vocabulary stays whole."""
    df = corpus(spark, 300)
    seen = []
    monkeypatch.setattr(skipgram, "WORDS_A_TASK", 500)
    kept = skipgram.checkpointed

    def watched(made):
        seen.append(made)
        return kept(made)

    monkeypatch.setattr(skipgram, "checkpointed", watched)
    words = {r.word for r in wo.train_word2vec(df, "t", vector_size=4, epochs=1).getVectors().collect()}
    assert words == {f"t{i}w{j}" for i in range(3) for j in range(8)} | {"left", "right"}
    assert "Repartition 4, true" in seen[0]._jdf.queryExecution().analyzed().toString()


def test_every_pair_is_trained_once(spark, monkeypatch):
    """Pairs across the edge of two steps are not lost, and texts are kept apart."""
    n, window = 40, 3
    counts = np.ones(n)
    text = np.repeat([0, 1, 2, 3], 10)

    def pairs(places):
        monkeypatch.setattr(skipgram, "PLACES", places)
        trainer = skipgram._Trainer(np.zeros((n, 2), np.float32), np.eye(n, 2, dtype=np.float32), counts, window,
                                    np.random.default_rng(3))
        seen = []
        monkeypatch.setattr(skipgram, "_missing", lambda score: seen.append(score.shape) or 0 * score + 0.5)
        moved = []
        monkeypatch.setattr(skipgram, "_change", lambda vectors, steps, ids, by, rate: moved.append((ids, by)) or ids)
        trainer.by = np.eye(n, n, dtype=np.float32)
        trainer.of = np.zeros((n, n), np.float32)
        monkeypatch.setattr(skipgram, "NEGATIVES", 0)
        trainer.learn(np.arange(n), text, lambda at: 1.0)
        total = np.zeros((n, n))
        for ids, by in moved[::2]:
            np.add.at(total, ids, by)
        return total

    whole, cut = pairs(4096), pairs(7)
    assert np.array_equal(whole, cut) and set(np.unique(whole)) == {0.0, 0.5}
    assert all(abs(i - j) <= window and text[i] == text[j] for i, j in np.argwhere(whole))
    assert all(whole[i, i + 1] == 0.5 for i in range(n - 1) if text[i] == text[i + 1])


def test_unknown_words_and_empty_vocabularies_are_refused(spark):
    with pytest.raises(ValueError):
        wo.train_word2vec(spark.createDataFrame([("a b",)], "t string"), "t", vector_size=4, epochs=1)
    model = wo.train_word2vec(spark.createDataFrame([("a b a b a b",)], "t string"), "t", vector_size=4, epochs=1)
    with pytest.raises(ValueError):
        wo.similar_words(model, "absent", 2)
