"""Best-fit packing of token sequences, with a bounded number of open bins.

Each document becomes the ids of the public tokenizer and an end id; only documents longer
than the capacity are cut, into pieces of the capacity. Pieces are placed online: the open
bins are kept by free space, and a bitset (one bit per amount of free space) names the bin
that a piece fills best, the one with the least free space that is enough. Only ``OPEN_BINS``
bins are open at a time; when one more is needed, the fullest closes first. A piece as long as
the capacity is a sequence of its own.

Tokens stay in the task that reads the document; the places of pieces (a few numbers each)
are shared out over one task per ``PIECES_PER_TASK`` pieces, so that few bins stay part full
at the ends of tasks. A task's memory is its open bins.

The tokenizer drops white space between words, so a text is the chain of its blank-separated
chunks, and a worker remembers the ids of chunks it has met, in two generations of bounded
size: what is used moves to the young one, and the old one is dropped when the young is full.
This is only a speed-up. Spark reuses its workers, so a worker that gets no other packing task in
``IDLE_SECONDS`` drops it all: the stages that follow do not hold it.

Defined cases: a null text is an empty one, and an empty text is the end id alone; each row
is a document of its own, also if doc_id is null or repeated; an empty table gives no rows.
"""

from __future__ import annotations

import gc
import re
import struct
import sys
import threading
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemicycle.llm.common import cut, wanted

CAPACITY, END_ID = 2048, 0
OPEN_BINS, PIECES_PER_TASK = 2048, 100_000
#: Bytes of one generation of remembered chunks; a worker holds two.
GENERATION_BYTES = 96 << 20
#: Seconds after its last packing task in which a worker keeps what it remembers.
IDLE_SECONDS = 2.0
#: Bytes of a remembered chunk beside its letters and ids: two objects and a place in a table.
ENTRY_BYTES = 200
#: Letters whose lower case and composed form are themselves or one letter away.
PLAIN = re.compile(r"[a-zà-öø-ÿ]+")
PLAIN_LETTERS = "".join(map(chr, (*range(0xE0, 0xF7), *range(0xF8, 0x100))))


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes are themselves, others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Memory(dict):
    """Chunk to ids. A chunk that is not there is looked up in the old generation, else encoded."""

    def __init__(self, encode: Callable[[str], bytes], most: int):
        super().__init__()
        self.encode, self.most, self.held = encode, most, 0
        self.old: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.encode(chunk)
        self.held += len(chunk) + len(ids) + ENTRY_BYTES
        if self.held > self.most:
            self.old, self.held = dict(self), 0
            self.clear()
        self[chunk] = ids
        return ids


class ChunkEncoder:
    """Ids of texts, as little-endian 32-bit bytes, with a memory of chunks."""

    def __init__(self, path: str, most: int = GENERATION_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        letters = byte_letters()
        self.to_letters = str.maketrans({c: "".join(letters[b] for b in c.encode()) for c in PLAIN_LETTERS})
        self.known = Memory(self.chunk, most)

    def slow(self, chunk: str) -> bytes:
        ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def word(self, word: str) -> bytes:
        """A lower-case word of plain letters: no normalising or splitting is needed."""
        known = self.known.get(word) or self.known.old.get(word)
        if known is not None:
            return known
        ids = [t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.to_letters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def chunk(self, chunk: str) -> bytes:
        lower = chunk.lower()
        if len(lower) == len(chunk):
            plain = str.isalpha if lower.isascii() else PLAIN.fullmatch
            if plain(lower):
                return self.word(lower)
            if lower[-1:] in (".", ",") and plain(lower[:-1]):
                return self.word(lower[:-1]) + self.known[lower[-1]]
        return self.slow(chunk)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, text.replace("\n", " ").split(" ")))


def encoder(path: str) -> ChunkEncoder:
    """One encoder per Python worker, kept for its next task; :func:`leave` ends its use."""
    kept = sys.modules["tokenizers"].__dict__ if "tokenizers" in sys.modules else {}
    waiting = kept.pop("_chunk_timer", None)
    if waiting is not None:
        waiting.cancel()
    found = kept.get("_chunk_encoder")
    if found is None or found[0] != path:
        found = (path, ChunkEncoder(path))
        sys.modules["tokenizers"].__dict__["_chunk_encoder"] = found
    return found[1]


def leave(seconds: float = IDLE_SECONDS) -> None:
    """The worker's encoder goes, with all it remembers, unless a task asks for it in time."""
    kept = sys.modules["tokenizers"].__dict__

    def forget() -> None:
        if kept.get("_chunk_timer") is timer:
            kept.pop("_chunk_timer", None)
            kept.pop("_chunk_encoder", None)
            gc.collect()  # the encoder and its memory name each other

    timer = threading.Timer(seconds, forget)
    timer.daemon = True
    kept["_chunk_timer"] = timer
    timer.start()


def cut_pieces(rows: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, text) to one row per piece: doc_id, piece, start, length, ids_crc32[, ids]."""
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long"
    schema += ", ids array<long>" if with_ids else ""
    end = np.array([END_ID], dtype="<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch], encode: Callable[[str], bytes]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                tokens = encode(text.as_py() or "") + end
                n = len(tokens) // 4
                for p, at in enumerate(range(0, n, capacity)):
                    part = tokens[4 * at: 4 * (at + capacity)]
                    owner.append(i)
                    piece.append(p)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int64))
            columns = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()),
                       *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(
                columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        try:
            yield from pieces(batches, encode)
        finally:
            leave()

    return rows.mapInArrow(run, schema)


class OpenBins:
    """Bins by free space. ``bits`` has bit f set if some open bin has f places free."""

    def __init__(self, capacity: int, most: int, first: int):
        self.capacity, self.most, self.next = capacity, most, first
        self.bits, self.open = 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, length: int) -> tuple[int, int]:
        """Sequence and offset of a piece."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            sequence = self.take(free)
        else:
            if self.open == self.most:
                self.take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            sequence, free = self.next, self.capacity
            self.next += 1
        left = free - length
        if left:
            self.by_free[left].append(sequence)
            self.bits |= 1 << left
            self.open += 1
        return sequence, self.capacity - free

    def take(self, free: int) -> int:
        sequence = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return sequence


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Add sequence_id and offset to rows with a ``length`` of 1 to ``capacity``."""
    n = pieces.count()
    tasks = max(1, -(-n // PIECES_PER_TASK))
    at = pieces.columns.index("length")
    names = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins = OpenBins(capacity, open_bins, TaskContext.get().partitionId() << 40)
        for batch in batches:
            placed = [bins.place(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([p[0] for p in placed], pa.int64()),
                 pa.array([p[1] for p in placed], pa.int64())],
                [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    dealt = pieces.repartition(tasks) if tasks > 1 else pieces.coalesce(1)
    return dealt.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS,
         with_ids: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every piece of every document with its place in a sequence.

    ``with_ids`` adds the token ids themselves; else only their CRC-32 is carried.
    """
    rows = wanted(documents, doc_id=id_column, text=text_column)
    return place_pieces(cut(cut_pieces(rows, tokenizer, capacity, with_ids)), capacity, open_bins)
