"""Word vectors by skip-gram with negative sampling.

Every task trains its part of the texts on a copy of the vectors, and the copies are averaged
after each epoch: a word's vector is the mean over the tasks that met it, weighted by how often
they did. Tasks hand on the words they met in blocks of ids, and a block is averaged in a task of
its own. The vocabulary, in order of frequency, is broadcast; a task holds two vectors a word. All
pairs within the window are trained on; before another epoch both sides' vectors are broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemicycle.operators.vocabulary import known_words, placed
from hemicycle.session import checkpointed

NEGATIVES, RATE, LEAST_RATE = 10, 0.2, 0.0001
#: Exponent of a word's frequency when negatives are drawn.
SMOOTHING = 0.75
#: Words of the corpus for which another task is worth its copy of the vectors.
WORDS_A_TASK = 1_000_000
#: Places that are trained at a time; of them, those that share ``SHARED`` drawn negatives.
PLACES, NEAR, SHARED = 2048, 32, 16
#: Numbers in a block of vectors.
BLOCK = 65_536


class _Trainer:
    """Vectors of one task: ``of`` as a word itself, ``by`` as a neighbour. Each vector has a step of
    its own, the rate over the root of its summed squared gradients."""

    def __init__(self, of: np.ndarray, by: np.ndarray, counts: np.ndarray, window: int, rng: np.random.Generator):
        self.of, self.by, self.window, self.rng = of, by, window, rng
        self.drawn = np.cumsum(counts.astype(np.float64) ** SMOOTHING)
        self.met, self.met_by = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
        self.steps, self.steps_by = np.full(len(of), 1e-12, np.float32), np.full(len(of), 1e-12, np.float32)

    def learn(self, ids: np.ndarray, text: np.ndarray, rate: Callable[[int], float]) -> None:
        """All pairs of the ids; ``text`` numbers the text of each, ``rate`` is asked by place."""
        reach = self.rng.integers(1, self.window + 1, len(ids))
        for at in range(0, len(ids), PLACES):
            # the places after the last one are partners of those before
            some = slice(at, at + PLACES + self.window)
            self._step(ids[some], text[some], reach[some], rate(at))
        np.add.at(self.met, ids, 1)

    def _step(self, ids: np.ndarray, text: np.ndarray, reach: np.ndarray, rate: float) -> None:
        n, size = len(ids), self.of.shape[1]
        x, y = self.of[ids], self.by[ids]
        dx, dy, pairs = np.zeros_like(x), np.zeros_like(y), np.zeros(n, np.float32)
        for d in range(1, min(self.window, n - 1) + 1):
            m = min(PLACES, n - d)
            left, right = slice(0, m), slice(d, d + m)
            same = text[left] == text[right]
            for a, b in ((left, right), (right, left)):
                real = (same & (reach[a] >= d)).astype(np.float32)
                g = real * _missing(np.einsum("ij,ij->i", x[a], y[b]))
                dx[a] += g[:, None] * y[b]
                dy[b] += g[:, None] * x[a]
                pairs[a] += real
        groups = -(-n // NEAR)
        places = np.zeros((groups * NEAR, size), np.float32)
        places[:n] = x
        places = places.reshape(groups, NEAR, size)
        weight = np.zeros(groups * NEAR, np.float32)
        weight[:n] = pairs * (NEGATIVES / SHARED)
        others = np.searchsorted(self.drawn, self.rng.random(groups * SHARED) * self.drawn[-1], side="right")
        z = self.by[others].reshape(groups, SHARED, size)
        g = -weight.reshape(groups, NEAR, 1) * _missing(-(places @ z.transpose(0, 2, 1)))
        dx += (g @ z).reshape(-1, size)[:n]
        dz = (g.transpose(0, 2, 1) @ places).reshape(-1, size)
        _change(self.of, self.steps, ids, dx, rate)
        hit = _change(self.by, self.steps_by, np.concatenate([ids, others]), np.concatenate([dy, dz]), rate)
        self.met_by[hit] += 1


def _missing(score: np.ndarray) -> np.ndarray:
    """One less the logistic function."""
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(score))


def _change(vectors: np.ndarray, steps: np.ndarray, ids: np.ndarray, by: np.ndarray, rate: float) -> np.ndarray:
    """Move the vector of every id along the sum of its gradients; the ids, each once."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    found, sums = ids[first], np.add.reduceat(by[order], first, axis=0)
    steps[found] += np.square(sums).mean(axis=1)
    vectors[found] += sums * (np.float32(rate) / np.sqrt(steps[found]))[:, None]
    return found


def _vectors(values: np.ndarray) -> pa.Array:
    offsets = pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))


def _one(values: np.ndarray) -> pa.Array:
    """A column of one row, which holds all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))


def train(rows: DataFrame, tokens: str, vector_size: int, window: int, min_count: int, epochs: int, seed: int,
          partitions: int) -> DataFrame:
    """(word, vector) of every word that occurs ``min_count`` times."""
    context = rows.sparkSession.sparkContext
    known = known_words(rows, tokens, min_count)
    total, size = pc.sum(known["c"]).as_py() or 0, known.num_rows
    if not size:
        raise ValueError(f"no word occurs {min_count} times")
    tasks = max(partitions, min(context.defaultParallelism, total // WORDS_A_TASK))
    splits = rows.rdd.getNumPartitions()
    dealt = rows.select(tokens).coalesce(tasks) if tasks <= splits else rows.select(tokens).repartition(tasks)
    vocabulary = context.broadcast((known["word"].combine_chunks(), known["c"].to_numpy()))
    share, block = -(-total // tasks), max(1, BLOCK // vector_size)

    def fresh() -> tuple[np.ndarray, np.ndarray]:
        of = np.random.default_rng(seed).random((size, vector_size), np.float32)
        return (of - np.float32(0.5)) / np.float32(vector_size), np.zeros((size, vector_size), np.float32)

    def trained(epoch: int, state) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, counts = vocabulary.value
            rng = np.random.default_rng([seed, epoch, TaskContext.get().partitionId()])
            of, by = fresh() if state is None else (x.copy() for x in state.value)
            trainer, done = _Trainer(of, by, counts, window, rng), 0
            for batch in batches:
                ids, text = placed(batch.column(0), words)
                real = ids >= 0
                ids, text, before = ids[real], text[real], done
                trainer.learn(ids, text, lambda at: max(
                    LEAST_RATE, RATE * (1 - (epoch * share + min(before + at, share)) / (epochs * share))))
                done += len(ids)
            sides = [(0, of, trainer.met)] + ([(1, by, trainer.met_by)] if epoch + 1 < epochs else [])
            for side, values, met in sides:
                for first in range(0, size, block):
                    at = np.flatnonzero(met[first: first + block]) + first
                    if len(at):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([side], pa.int32()), pa.array([first], pa.int64()), _one(at), _one(met[at]),
                             _one(values[at].ravel())], names=["side", "first", "ids", "met", "numbers"])

        return run

    def averaged(parts: pa.Table) -> pa.Table:
        first, side = parts["first"][0].as_py(), parts["side"][0].as_py()
        n = min(block, size - first)
        sums, met = np.zeros((n, vector_size)), np.zeros(n)
        for i in range(parts.num_rows):
            at, weight = (parts[c][i].values.to_numpy() for c in ("ids", "met"))
            at = at - first
            sums[at] += weight[:, None] * parts["numbers"][i].values.to_numpy().reshape(-1, vector_size)
            met[at] += weight
        at = np.flatnonzero(met)
        return pa.table({
            "side": pa.array(np.full(len(at), side, np.int32)), "id": pa.array(at + first),
            "word": vocabulary.value[0].take(pa.array(at + first)),
            "vector": _vectors((sums[at] / met[at, None]).astype(np.float32))})

    state = made = None
    for epoch in range(epochs):
        parts = dealt.mapInArrow(trained(epoch, state), "side int, first long, ids array<long>, met array<long>, numbers array<float>")
        made = checkpointed(parts.groupBy("side", "first").applyInArrow(
            averaged, "side int, id long, word string, vector array<float>"))
        if epoch + 1 < epochs:
            state = context.broadcast(_gathered(made, fresh() if state is None else state.value))
    return made.where("side = 0").select("word", "vector")


def _gathered(made: DataFrame, before: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Both sides as matrices; words that no task met stay as they were."""
    sides = []
    for side, old in enumerate(before):
        found = made.where(F.col("side") == side).select("id", "vector").toArrow()
        values = old.copy()
        values[found["id"].to_numpy()] = found["vector"].combine_chunks().flatten().to_numpy().reshape(-1, old.shape[1])
        sides.append(values)
    return sides[0], sides[1]
