"""Exact removal of repeated byte strings, over sampled suffixes in sorted order.

A byte goes if it is covered by a ``MATCH``-byte string that also starts in a document with
a smaller doc_id. Sorting the suffixes at every byte would move many times the corpus, so
suffixes are taken where content decides: the leading token of a ``MATCH``-byte string is
its ``TOKEN``-byte gram of least hash, and neighbouring strings with one leading token form a
phrase (the string of all their bytes). Equal strings have equal leading tokens wherever they
stand, so every repeat meets under its token, and about one suffix per 15 bytes is sorted.

1. Texts are gathered into compressed chunks of a few MB, a table that all passes read.
2. Each chunk sends one record per distinct phrase: leading token (40 bits), phrase (56
   bits of hash), least doc_id. Records are range-partitioned by token and phrase with
   splitters sampled from a few chunks; a bucket sorts its records by multikey quicksort
   (the next key is looked at only inside ties). A phrase that stands in an earlier document
   is repeated as a whole. A token with several phrases (also one that a splitter cuts, whose
   neighbours stand in another bucket) leaves its phrases open: parts of them may repeat.
3. The first document of each open phrase sends the phrase itself; under each token the
   ``MATCH``-byte strings of its phrases are compared one by one. Strings under a token cut
   by a splitter are compared across buckets: they are dealt by their own hash.
4. Answers go back to the chunks as bits in the order of what was sent; each chunk derives
   the removed spans of its documents.

A text or phrase shared by a third of all documents sends one record per chunk, never one
per document. Equality of phrases rests on 96 bits, of strings on 128 bits of hash.

Defined cases: a null text is an empty one; rows without doc_id are neither compared nor
cut; rows that share a doc_id do not cut each other; texts shorter than ``MATCH`` bytes stay
whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemicycle.llm.common import cut, wanted

MATCH, TOKEN = 50, 24
CHUNK_BYTES, RECORDS_PER_BUCKET, SAMPLE_CHUNKS, SAMPLE_KEYS = 4 << 20, 1_500_000, 32, 2000
#: Window starts of one text that are hashed at a time.
PIECE = 1 << 20
MIX = 0x9E3779B97F4A7C15


def compress(value: object) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(value, protocol=5))


def expand(blob: bytes) -> object:
    import zstandard

    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def planes(values: np.ndarray) -> np.ndarray:
    """Bytes of integers, one plane per byte: sorted or small values then compress well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)


def from_planes(stored: np.ndarray, kind: str) -> np.ndarray:
    return np.ascontiguousarray(stored.T).view(kind).ravel()


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the TOKEN bytes from each place on, by doubling spans."""
    table = np.random.default_rng(MATCH).integers(0, 2**64, 256, dtype=np.uint64)
    spans, factor, size = [table[data]], MIX, 1
    factors = [np.uint64(factor)]
    while size * 2 <= TOKEN:
        spans.append(spans[-1][:-size] * factors[-1] + spans[-1][size:])
        factor = factor * factor % 2**64
        factors.append(np.uint64(factor))
        size *= 2
    n, at, total = len(data) - TOKEN + 1, 0, None
    for level in range(len(spans) - 1, -1, -1):
        if TOKEN >> level & 1:
            part = spans[level][at: at + n]
            total = part.copy() if total is None else total * factors[level] + part
            at += 1 << level
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(32))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def phrases(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leading token (40 bits), first and end string start of every phrase of a text."""
    n = len(text) - MATCH + 1
    tokens, starts, last = [], [], None
    for at in range(0, max(0, n), PIECE):
        m = min(PIECE, n - at)
        data = np.frombuffer(text, np.uint8, m + MATCH - 1, at)
        least = sliding_least(gram_hashes(data), MATCH - TOKEN + 1) >> np.uint64(24)
        new = np.append(last is None or least[0] != last, least[1:] != least[:-1])
        where = np.flatnonzero(new)
        tokens.append(least[where])
        starts.append(where + at)
        last = least[-1]
    if not tokens:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    start = np.concatenate(starts)
    return np.concatenate(tokens), start, np.append(start[1:], n)


@dataclass
class Chunk:
    """Documents of a chunk, their phrases, and the distinct phrases in sorted order."""

    ids: np.ndarray
    known: np.ndarray  # has a doc_id
    texts: list[bytes]
    owner: np.ndarray  # per phrase: place of its document
    start: np.ndarray
    end: np.ndarray
    record: np.ndarray  # per phrase: its place among the distinct ones
    high: np.ndarray  # per distinct phrase: token and 24 bits of the phrase
    low: np.ndarray  # 32 more bits
    first: np.ndarray  # least doc_id


def multikey_order(high: np.ndarray, low: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Multikey quicksort: by the first key, then, only inside ties, by the next ones."""
    order = np.argsort(high, kind="quicksort")
    ordered = high[order]
    same = ordered[1:] == ordered[:-1]
    tied = np.append(same, False) | np.append(False, same)
    places = np.flatnonzero(tied)
    part = order[places]
    order[places] = part[np.lexsort((ids[part], low[part], high[part]))]
    return order


def open_chunk(blobs: list[bytes]) -> Chunk:
    from xxhash import xxh3_64_intdigest

    ids, known, texts = [], [], []
    for blob in blobs:
        some_ids, some_known, some_texts = expand(blob)
        ids.append(some_ids)
        known.append(some_known)
        texts.extend(some_texts)
    doc_ids, has_id = np.concatenate(ids), np.concatenate(known)
    owner, start, end, token, phrase = [], [], [], [], []
    for i, text in enumerate(texts):
        if not has_id[i]:
            continue
        t, a, b = phrases(text)
        token.append(t)
        start.append(a)
        end.append(b)
        owner.append(np.full(len(t), i))
        phrase.extend([xxh3_64_intdigest(text[x:y]) for x, y in zip(a.tolist(), (b + MATCH - 1).tolist())])
    join = (lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind))
    owner, start, end = join(owner, np.int64), join(start, np.int64), join(end, np.int64)
    token, body = join(token, np.uint64), np.array(phrase, np.uint64)
    high = (token << np.uint64(24)) | (body >> np.uint64(40))
    low = ((body >> np.uint64(8)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    order = multikey_order(high, low, doc_ids[owner])
    sorted_high, sorted_low = high[order], low[order]
    new = np.append(True, (sorted_high[1:] != sorted_high[:-1]) | (sorted_low[1:] != sorted_low[:-1]))[: len(order)]
    record = np.empty(len(order), np.int64)
    record[order] = np.cumsum(new) - 1
    return Chunk(doc_ids, has_id, texts, owner, start, end, record,
                 sorted_high[new], sorted_low[new], doc_ids[owner[order[new]]])


def to_chunks(rows: DataFrame, partitions: int) -> DataFrame:
    """(chunk, n_bytes, blob): texts in scan order, ``CHUNK_BYTES`` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            all_ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            texts = batch.column(1).cast(pa.binary())
            begin, size, held = 0, 0, []
            for i in range(batch.num_rows):
                held.append(texts[i].as_py() or b"")
                size += len(held[-1])
                if size >= CHUNK_BYTES or i == batch.num_rows - 1:
                    blob = compress((all_ids[begin: i + 1].copy(), known[begin: i + 1].copy(), held))
                    name = xxh3_64_intdigest(blob) - (1 << 63)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name], pa.int64()), pa.array([size], pa.int64()), pa.array([blob], pa.binary())],
                        ["chunk", "n_bytes", "blob"])
                    begin, size, held = i + 1, 0, []

    chunks = rows.mapInArrow(run, "chunk long, n_bytes long, blob binary")
    return cut(chunks.repartition(partitions, "chunk"))


def splitters_of(chunks: DataFrame) -> np.ndarray:
    """Splitters of the record keys, from the phrases of about ``SAMPLE_CHUNKS`` chunks."""
    n, n_bytes = chunks.agg(F.count("*"), F.sum("n_bytes")).first()
    buckets = -(-int(n_bytes or 0) // (RECORDS_PER_BUCKET * 14))
    if buckets <= 1:
        return np.zeros(0, np.uint64)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                high = open_chunk([blob.as_py()]).high
                some = high[:: max(1, len(high) // SAMPLE_KEYS)]
                yield pa.RecordBatch.from_arrays([pa.array([some.tobytes()], pa.binary())], ["keys"])

    some = chunks.where(F.pmod("chunk", F.lit(max(1, n // SAMPLE_CHUNKS))) == 0).select("blob")
    sample = [np.frombuffer(r["keys"], np.uint64) for r in some.mapInArrow(keys, "keys binary").collect()]
    pool = np.sort(np.concatenate(sample)) if sample else np.zeros(0, np.uint64)
    if not len(pool):  # no chunk fell into the sample: even splitters of skewed keys, still right
        return np.linspace(0, 2.0**60, buckets, dtype=np.float64)[1:].astype(np.uint64)
    return np.unique(pool[np.linspace(0, len(pool) - 1, buckets + 1).astype(int)[1:-1]])


def record_batches(splitters: np.ndarray):
    """Chunks to (bucket, chunk, blob): their records, cut at the splitters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                c = open_chunk([blob.as_py()])
                edges = np.concatenate([[0], np.searchsorted(c.high, splitters), [len(c.high)]])
                buckets, blobs = [], []
                for bucket, (a, b) in enumerate(zip(edges, edges[1:])):
                    if b > a:
                        buckets.append(bucket)
                        blobs.append(compress((planes(c.high[a:b]), planes(c.low[a:b]), planes(c.first[a:b]))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(buckets, pa.int32()), pa.array([name] * len(buckets), pa.int64()),
                     pa.array(blobs, pa.binary())], ["bucket", "chunk", "blob"])

    return run


WHOLE, OPEN = 1, 2
ANSWER = "chunk long, kind int, bucket int, bits binary"


def answer_table(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    chunk, kind, bucket, bits = zip(*rows) if rows else ((), (), (), ())
    return pa.table({"chunk": pa.array(chunk, pa.int64()), "kind": pa.array(kind, pa.int32()),
                     "bucket": pa.array(bucket, pa.int32()), "bits": pa.array(bits, pa.binary())})


def judge_records(splitters: np.ndarray):
    """A bucket's records to one answer per chunk: WHOLE, OPEN or nothing, per record."""
    cut_tokens = np.unique(splitters >> np.uint64(24))

    def run(table: pa.Table) -> pa.Table:
        parts = [expand(x.as_py()) for x in table.column("blob")]
        high = np.concatenate([from_planes(p[0], "u8") for p in parts])
        low = np.concatenate([from_planes(p[1], "u4") for p in parts])
        first = np.concatenate([from_planes(p[2], "i8") for p in parts])
        order = multikey_order(high, low, first)
        h, s, ids = high[order], low[order], first[order]
        token = h >> np.uint64(24)
        new_token = np.append(True, token[1:] != token[:-1])
        new_phrase = new_token | np.append(True, (h[1:] != h[:-1]) | (s[1:] != s[:-1]))
        least = ids[np.maximum.accumulate(np.where(new_phrase, np.arange(len(h)), 0))]
        group = np.cumsum(new_token) - 1
        several = (np.bincount(group, new_phrase) > 1)[group] | np.isin(token, cut_tokens)
        codes = np.empty(len(h), np.uint8)
        codes[order] = np.where(ids > least, WHOLE, np.where(several, OPEN, 0))
        rows, at, bucket = [], 0, table.column("bucket")[0].as_py()
        for name, part in zip(table.column("chunk").to_pylist(), parts):
            n = part[0].shape[1]
            rows.append((name, 0, bucket, codes[at: at + n].tobytes()))
            at += n
        return answer_table(rows)

    return run


def codes_of(chunk: Chunk, answers: list[tuple[int, bytes]]) -> np.ndarray:
    codes = np.frombuffer(b"".join(bits for _, bits in sorted(answers)), np.uint8)
    if len(codes) != len(chunk.high):
        raise RuntimeError("answers do not fit the chunk they are for")
    return codes


def first_phrases(chunk: Chunk, codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Open phrases in the order of their records: one place each, in the first document, and
    all their places there and in rows that share its doc_id."""
    held = (codes[chunk.record] == OPEN) & (chunk.ids[chunk.owner] == chunk.first[chunk.record])
    at = np.flatnonzero(held)
    at = at[np.argsort(chunk.record[at], kind="stable")]
    _, one = np.unique(chunk.record[at], return_index=True)
    return at[one], np.split(at, one[1:])


def strings_of(text: bytes, start: int, end: int) -> list[bytes]:
    return [text[i: i + MATCH] for i in range(start, end)]


def questions(chunk: Chunk, codes: np.ndarray, cut_tokens: np.ndarray, buckets: int) -> dict[int, tuple]:
    """What a chunk asks, by bucket: doc ids, lengths and bytes of its open phrases.

    Phrases under a token that a splitter cuts are asked string by string, once per chunk
    with the least doc_id.
    """
    from xxhash import xxh3_64_intdigest

    at, _ = first_phrases(chunk, codes)
    token = chunk.high[chunk.record[at]] >> np.uint64(24)
    crossing = np.isin(token, cut_tokens)
    asked: dict[int, list[tuple[int, bytes]]] = {}
    single: dict[bytes, int] = {}
    spread = (token * np.uint64(MIX) >> np.uint64(20)) % np.uint64(buckets)
    for i, crosses, bucket in zip(at.tolist(), crossing.tolist(), spread.tolist()):
        text, doc_id = chunk.texts[chunk.owner[i]], int(chunk.ids[chunk.owner[i]])
        if crosses:
            for string in strings_of(text, chunk.start[i], chunk.end[i]):
                if doc_id < single.get(string, doc_id + 1):
                    single[string] = doc_id
        else:
            asked.setdefault(bucket, []).append((doc_id, text[chunk.start[i]: chunk.end[i] + MATCH - 1]))
    for string in sorted(single):
        asked.setdefault(xxh3_64_intdigest(string) % buckets, []).append((single[string], string))
    return {
        bucket: (np.array([d for d, _ in rows], np.int64), np.array([len(b) for _, b in rows], np.int64),
                 b"".join(b for _, b in rows))
        for bucket, rows in asked.items()
    }


def judge_strings(table: pa.Table) -> pa.Table:
    """A bucket's open phrases to one answer per chunk: a bit per string, set if the string
    starts in an earlier document."""
    from xxhash import xxh3_128_digest

    parts = [expand(x.as_py()) for x in table.column("blob")]
    digests, ids, counts = [], [], []
    for doc_ids, lengths, data in parts:
        ends = np.cumsum(lengths)
        n = 0
        for doc_id, a, b in zip(doc_ids.tolist(), (ends - lengths).tolist(), ends.tolist()):
            digests.extend([xxh3_128_digest(data[i: i + MATCH]) for i in range(a, b - MATCH + 1)])
            n += b - a - MATCH + 1
        ids.append(np.repeat(doc_ids, lengths - MATCH + 1))
        counts.append(n)
    hashes = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    del digests
    owner = np.concatenate(ids)
    order = np.lexsort((owner, hashes[:, 1], hashes[:, 0]))
    h, o = hashes[order], owner[order]
    new = np.append(True, (h[1:] != h[:-1]).any(axis=1))
    least = o[np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))]
    bits = np.empty(len(o), np.uint8)
    bits[order] = o > least
    rows, at, bucket = [], 0, table.column("bucket")[0].as_py()
    for name, n in zip(table.column("chunk").to_pylist(), counts):
        rows.append((name, 1, bucket, np.packbits(bits[at: at + n]).tobytes()))
        at += n
    return answer_table(rows)


def repeated_strings(chunk: Chunk, codes: np.ndarray, cut_tokens: np.ndarray, buckets: int,
                     answers: list[tuple[int, bytes]]) -> Iterator[tuple[int, int]]:
    """(document place, string start) of the repeated strings in open phrases, at every place
    of the phrase in its first document."""
    from xxhash import xxh3_64_intdigest

    bits = {bucket: np.unpackbits(np.frombuffer(b, np.uint8)) for bucket, b in answers}
    used = dict.fromkeys(bits, 0)

    def answered(bucket: int, n: int) -> np.ndarray:
        at = used[bucket]
        used[bucket] = at + n
        return bits[bucket][at: at + n]

    at, places = first_phrases(chunk, codes)
    token = chunk.high[chunk.record[at]] >> np.uint64(24)
    crossing = np.isin(token, cut_tokens)
    spread = (token * np.uint64(MIX) >> np.uint64(20)) % np.uint64(buckets)
    single: dict[bytes, int] = {}
    crossed = []
    for i, everywhere, crosses, bucket in zip(at.tolist(), places, crossing.tolist(), spread.tolist()):
        owner, start, end = int(chunk.owner[i]), int(chunk.start[i]), int(chunk.end[i])
        stands = list(zip(chunk.owner[everywhere].tolist(), chunk.start[everywhere].tolist()))
        if crosses:
            doc_id = int(chunk.ids[owner])
            crossed.append((owner, start, end, stands))
            for string in strings_of(chunk.texts[owner], start, end):
                if doc_id < single.get(string, doc_id + 1):
                    single[string] = doc_id
        else:
            for offset in np.flatnonzero(answered(bucket, end - start)).tolist():
                for place, begin in stands:
                    yield place, begin + offset
    earlier = {}
    for string in sorted(single):
        earlier[string] = bool(answered(xxh3_64_intdigest(string) % buckets, 1)[0])
    for owner, start, end, stands in crossed:
        doc_id = int(chunk.ids[owner])
        for offset, string in enumerate(strings_of(chunk.texts[owner], start, end)):
            if earlier[string] or single[string] < doc_id:
                for place, begin in stands:
                    yield place, begin + offset


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union of [start, end)."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > reach[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return list(zip(starts[first].tolist(), reach[last].tolist()))


def removed_spans(chunk: Chunk, codes: np.ndarray, strings: Iterator[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    whole = (codes[chunk.record] == WHOLE) | (chunk.ids[chunk.owner] > chunk.first[chunk.record])
    more = np.array(list(strings), np.int64).reshape(-1, 2)
    owner = np.concatenate([chunk.owner[whole], more[:, 0]])
    start = np.concatenate([chunk.start[whole], more[:, 1]])
    end = np.concatenate([chunk.end[whole] + MATCH - 1, more[:, 1] + MATCH])
    order = np.argsort(owner, kind="stable")
    edges = np.searchsorted(owner[order], np.arange(len(chunk.texts) + 1))
    return [merged(start[order[a:b]], end[order[a:b]]) for a, b in zip(edges, edges[1:])]


def split_answers(table: pa.Table, kind: int) -> list[tuple[int, bytes]]:
    """Answers by bucket; chunks alike in every byte have equal ones, which count once."""
    return list({r["bucket"]: r["bits"] for r in table.to_pylist() if r["kind"] == kind}.items())


def one_chunk(table: pa.Table) -> Chunk:
    return open_chunk([table.column("blob")[0].as_py()])


def dedup_spans(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                with_text: bool = False) -> DataFrame:
    """Every document with n_bytes, its removed spans [start, end) in bytes, the SHA-256 of
    what is kept and, on request, the kept bytes themselves."""
    spark = documents.sparkSession
    rows = wanted(documents, doc_id=id_column, text=text_column).select(F.col("doc_id").cast("long"), "text")
    chunks = to_chunks(rows, int(spark.conf.get("spark.sql.shuffle.partitions")))
    splitters = splitters_of(chunks)
    cut_tokens, buckets = np.unique(splitters >> np.uint64(24)), len(splitters) + 1
    records = chunks.select("chunk", "blob").mapInArrow(
        record_batches(splitters), "bucket int, chunk long, blob binary")
    answers = cut(records.groupBy("bucket").applyInArrow(judge_records(splitters), ANSWER))

    def ask(texts: pa.Table, told: pa.Table) -> pa.Table:
        names, to, blobs = [], [], []
        if texts.num_rows:
            chunk = one_chunk(texts)
            asked = questions(chunk, codes_of(chunk, split_answers(told, 0)), cut_tokens, buckets)
            for bucket, question in asked.items():
                names.append(texts.column("chunk")[0].as_py())
                to.append(bucket)
                blobs.append(compress(question))
        return pa.table({"bucket": pa.array(to, pa.int32()), "chunk": pa.array(names, pa.int64()),
                         "blob": pa.array(blobs, pa.binary())})

    by_chunk = chunks.groupBy("chunk")
    open_phrases = by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(ask, "bucket int, chunk long, blob binary")
    more = cut(open_phrases.groupBy("bucket").applyInArrow(judge_strings, ANSWER))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def finish(texts: pa.Table, told: pa.Table) -> pa.Table:
        ids, sizes, spans, digests, kept = [], [], [], [], []
        for copy in range(texts.num_rows):  # chunks alike in every byte are listed each
            if copy == 0:
                chunk = one_chunk(texts)
                codes = codes_of(chunk, split_answers(told, 0))
                found = removed_spans(chunk, codes, repeated_strings(
                    chunk, codes, cut_tokens, buckets, split_answers(told, 1)))
            for doc_id, known, text, runs in zip(chunk.ids.tolist(), chunk.known.tolist(), chunk.texts, found):
                ends = [0, *[b for _, b in runs]]
                rest = b"".join(text[a:b] for a, b in zip(ends, [*[a for a, _ in runs], len(text)]))
                ids.append(doc_id if known else None)
                sizes.append(len(text))
                spans.append([{"start": a, "end": b} for a, b in runs])
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest if with_text else None)
        columns = {"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()),
                   "spans": pa.array(spans, span), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(columns | ({"kept": pa.array(kept, pa.binary())} if with_text else {}))

    schema = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept_sha256 string"
    told = answers.unionByName(more)
    return by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(finish, schema + (", kept binary" if with_text else ""))


def dedup_report(documents: DataFrame) -> DataFrame:
    """Per document: bytes, bytes removed, number of removed runs, hash of what is kept."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return dedup_spans(documents).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
