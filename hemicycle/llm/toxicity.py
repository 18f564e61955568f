"""Toxicity by multiple-instance learning: documents are labelled, sentences are found.

A sentence is toxic with probability s(b + sum of the weights of its distinct features), the
features being its words and their first three, four and five letters; a document is toxic
unless every sentence is clean and its label is not noise:

    P = 1 - (1 - leak) * product over sentences of (1 - p)          (noisy-or)

Weights, b and the leak are learned from document labels only, by gradient ascent on the
likelihood of that noisy-or, on a bounded sample of labelled documents. Features enter the
model if their document frequencies in the two classes of the sample differ clearly. Every
text is then scored whole, and sentences with p >= 0.5 are reported with their places.

Defined cases: a null or empty text has no sentence, so its score is the leak; labels that
are null, or texts without label, take no part in training; a doc_id labelled twice counts
as toxic if either label is; rows with the same doc_id are scored each; without training
rows of both kinds every score is the share of toxic labels (0.0 without any).
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemicycle.llm.common import text_of, wanted
from hemicycle.llm.sampling import SAMPLE_CHARS, labelled_sample

#: Bound of the training sample, per class.
SAMPLE_PER_LABEL = 4000
MOST_FEATURES, LEAST_DOCUMENTS, LEAST_Z = 2000, 5, 5.0
STEPS, RATE, RIDGE = 300, 0.5, 1e-5
PREFIXES = (3, 4, 5)
THRESHOLD, OFFENDING = 0.7, 0.5
#: Words that a task remembers before it starts anew (a speed-up only).
CACHED_WORDS = 200_000

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    return [word, *[word[:k] + "*" for k in PREFIXES if len(word) >= k]]


def sentence_features(sentence: str) -> set[str]:
    return {f for word in set(WORD.findall(sentence)) for f in features(word)}


@dataclass
class Model:
    """Weights per feature, bias per sentence, leak per document."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    leak: float = 0.0

    def probability(self, found: set[str]) -> float:
        z = self.bias + sum(self.weights[f] for f in found)
        return float(1.0 / (1.0 + np.exp(-z)))

    def score(self, text: str, cache: dict[str, list[str]]) -> tuple[float, list[tuple[int, int, float]]]:
        """P of the document, and (start, end, p) of its offending sentences.

        ``cache`` keeps the weighted features of words between calls.
        """
        if not self.weights:
            return self.leak, []
        lower = text.lower()
        if len(lower) != len(text):  # keep places: a few letters change length in lower case
            lower = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        plain = self.probability(set())
        clean, spans = 0.0, []
        for match in SENTENCE.finditer(lower):
            found: set[str] = set()
            for word in WORD.findall(match[0]):
                known = cache.get(word)
                if known is None:
                    known = cache[word] = [f for f in features(word) if f in self.weights]
                if known:
                    found.update(known)
            p = self.probability(found) if found else plain
            clean += np.log1p(-min(p, 1 - 1e-12))
            if p >= OFFENDING:
                spans.append((match.start(), match.end(), p))
        return float(1.0 - (1.0 - self.leak) * np.exp(clean)), spans


def train(sample: list[tuple[str, int]]) -> Model:
    """Fit the noisy-or on (text, 0/1) rows."""
    labels = np.array([y for _, y in sample], float)
    if len(labels) == 0 or labels.min() == labels.max():
        return Model(leak=float(labels.mean()) if len(labels) else 0.0)
    seen: dict[str, list[int]] = {}
    for text, y in sample:
        for word in sentence_features(text.lower()):
            seen.setdefault(word, [0, 0])[int(y)] += 1
    n0, n1 = float((labels == 0).sum()), float((labels == 1).sum())
    ranked = []
    for word, (a, b) in seen.items():
        if a + b >= LEAST_DOCUMENTS:
            mean = (a + b) / (n0 + n1)
            z = abs(b / n1 - a / n0) / np.sqrt(mean * (1 - mean) * (1 / n0 + 1 / n1) + 1e-12)
            if z >= LEAST_Z:
                ranked.append((-z, word))
    place = {word: i for i, (_, word) in enumerate(sorted(ranked)[:MOST_FEATURES])}
    del seen, ranked
    # a second pass keeps only the places of chosen features: the sample's own size at most
    owner, sentence_of, word_of = array("l"), array("l"), array("l")
    for document, (text, _) in enumerate(sample):
        for sentence in SENTENCE.findall(text.lower()):
            for word in sentence_features(sentence) & place.keys():
                sentence_of.append(len(owner))
                word_of.append(place[word])
            owner.append(document)
    return fit(labels, np.array(owner, int), np.array(sentence_of, int), np.array(word_of, int), list(place))


def fit(labels: np.ndarray, owner: np.ndarray, sentence_of: np.ndarray, word_of: np.ndarray,
        words: list[str]) -> Model:
    """Adam on the mean log-likelihood; parameters: word weights, bias, logit of the leak."""
    n, n_words = len(labels), len(words)
    theta = np.concatenate([np.zeros(n_words), [-6.0, -3.0]])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        z = theta[n_words] + np.bincount(sentence_of, theta[word_of], len(owner))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        leak = 1 / (1 + np.exp(-theta[-1]))
        clean = np.log(1 - leak) + np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-9)), n)
        # d loglik / d clean: -1 for label 0 is +1 on log(1 - P); for label 1, -q / (1 - q)
        q = np.exp(np.minimum(clean, -1e-9))
        pull = np.where(labels == 1, -q / (1 - q), 1.0)
        at_sentence = -pull[owner] * p
        slope = np.concatenate([
            np.bincount(word_of, at_sentence[sentence_of], n_words) / n - RIDGE * theta[:n_words],
            [at_sentence.sum() / n, -(pull * leak).sum() / n],
        ])
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope * slope
        rate = RATE / (1 + step / 100)
        theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        theta[n_words] = min(theta[n_words], -2.0)
        theta[-1] = np.clip(theta[-1], -12.0, 1.0)
    return Model(dict(zip(words, theta[:n_words].tolist())), float(theta[n_words]),
                 float(1 / (1 + np.exp(-theta[-1]))))


def score_texts(rows: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) to (doc_id, score, offending): spans in characters, with p."""
    span = "array<struct<start:int,end:int,p:double>>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, list[str]] = {}
        for batch in batches:
            if len(cache) > CACHED_WORDS:
                cache.clear()
            scores, spans = [], []
            for text in batch.column(1):
                score, found = model.score(text.as_py() or "", cache)
                scores.append(score)
                spans.append([{"start": a, "end": b, "p": p} for a, b, p in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)],
                ["doc_id", "score", "offending"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, score double, offending {span}")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def find_toxic(documents: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL,
               id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
               most_chars: int = SAMPLE_CHARS) -> DataFrame:
    """Every document with held_out, score, predicted and its offending sentences.

    Only labels of documents that are not held out are learned from: of ``per_label`` texts a
    class, those of at most ``most_chars`` characters. Texts are scored whole.
    """
    texts = wanted(documents, doc_id=id_column, text=text_column)
    known = wanted(labels, doc_id=id_column, label=label_column)
    known = (
        known.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    )
    model = train(labelled_sample(texts, known, per_label, most_chars))
    scored = score_texts(texts.select("doc_id", text_of("text").alias("text")), model)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "offending")
