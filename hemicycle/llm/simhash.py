"""Near-duplicates by SimHash fingerprints and deletion-variant signatures.

A fingerprint of 64 bits per seed takes the majority of the hashes of a text's word shingles.
It is cut into segments, few enough that two fingerprints within the distance sought differ
in some segment by at most one bit. Each segment is indexed once per bit position with that
position as a wildcard: two segments that differ by at most one bit then agree in a variant.
Fingerprints that meet by equality on (segment, position, other bits) are verified.

* Equal fingerprints are one class before anything is indexed, so exact copies, however
  many, cost one row per task.
* Buckets are read in order (fingerprints sorted by bucket in Spark) and pairs inside are
  verified where they meet; a bucket gives only links that join what was apart, so its output
  is smaller than its size. Buckets over ``BUCKET_ROWS`` fingerprints are not compared pair by
  pair: for a distance of 2 their members are linked exactly through shared neighbours (two
  fingerprints are within 2 bits if and only if some 64-bit word is within 1 bit of both),
  one row per neighbour; at most 65 fingerprints share a neighbour.
* Links become classes in :mod:`components`; no links or fingerprints are collected.

``keep_one`` (used by the pipeline) links five-word-shingle sets of Jaccard similarity 0.8 or
more. At 0.8 about 15 % of the bits differ, so it takes 384 bits in eighteen segments of 21 or 22
bits and looks up to 78 of them away. The shortest links that connect what meets make kins of
candidates; within a kin every pair is compared by the exact similarity of the two shingle sets,
block against block, with each set sent once for every block, and only links that join what was
apart leave a task. The variants of four neighbouring wildcards travel as one
row (108 rows a fingerprint, not 384) and part where they meet. Groups of over ``CROWD`` rows are
dealt in blocks of which every two meet in a task: memory is bounded, the work of all tasks
grows with the square of a group's, or a kin's, different fingerprints.

Defined cases: A-Z are lower-cased; words are runs of anything but blank and 09-0D; fewer
words than a shingle make one shingle of all of them; no words (null or empty text): the
fingerprint zero, linked like any other; rows with the same doc_id keep their own
fingerprint and class; a null doc_id is never the id of a class, unless the class has no
other (then null); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hemicycle.llm.common import cut, hinted, wanted
from hemicycle.llm.components import components, roots
from hemicycle.llm.line_dedup import ROW_HASH, ROW_ID, keyed

SHINGLE, DISTANCE, SEGMENTS, SEED = 3, 2, 2, 42
BUCKET_ROWS = 64
#: For the pipeline: five-word shingles, six words of 64 bits in three segments each.
STAGE_SHINGLE, STAGE_WORDS, STAGE_SEGMENTS, SIMILARITY = 5, 6, 3, 0.8
#: Bits that are looked across.
STAGE_DISTANCE = 78
#: Wildcard bits of a segment that travel as one row.
STEP = 4
#: Rows of a group that are compared in one task.
CROWD = 2048
#: Fingerprints that a task makes rows for groups of: a hundred of each.
SPREAD = 1 << 14
#: Rows of a bucket up to which all its pairs are compared at once, with those of other buckets.
FEW = 64
CROWDED_SCHEMA = "a array<long>, b array<long>, part short, rest long, inside short"
CROWDED_NAMES = ["a", "b", "part", "rest", "inside"]
#: Shingle sets of a block of candidates: bytes, and rows.
BLOCK_BYTES, BLOCK_ROWS = 16 << 20, 4096
#: Shingles that are counted, and links that are given, at a time.
PIECE = 1 << 16


def shingle_hashes(text: bytes, size: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of all word shingles of a text, repeats included, in pieces."""
    import xxhash

    words = text.lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(size, len(words))
    starts, ends = starts[: len(words) - size + 1], ends[size - 1:]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), PIECE):
        spans = zip(starts[at: at + PIECE].tolist(), ends[at: at + PIECE].tolist())
        yield np.array([digest(joined[a:b], seed) for a, b in spans], dtype="<u8")


def mixed(hashes: np.ndarray, words: int) -> np.ndarray:
    """``words`` rows of hashes of the same shingles: those given, and others made of them."""
    x = hashes ^ (np.arange(words, dtype="<u8")[:, None] * np.uint64(0x9E3779B97F4A7C15))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x[1:] = (x[1:] ^ (x[1:] >> np.uint64(shift))) * np.uint64(factor)
    x[1:] ^= x[1:] >> np.uint64(31)
    return x


def votes(hashes: np.ndarray) -> np.ndarray:
    """Of rows of hashes: how many of a row set each of the 64 bits."""
    found = np.zeros((len(hashes), 64), np.int64)
    for at in range(0, hashes.shape[1], 255):  # their sums fit an octet
        some = np.ascontiguousarray(hashes[:, at: at + 255], "<u8")
        bits = np.unpackbits(some.view(np.uint8), axis=1, bitorder="little").reshape(len(some), -1, 64)
        found += np.add.reduce(bits, axis=1, dtype=np.uint8)
    return found


def shingle_set(text: bytes, size: int, seed: int = SEED) -> np.ndarray:
    """The different shingle hashes of a text, sorted."""
    return np.unique(np.concatenate([np.zeros(0, "<u8"), *shingle_hashes(text, size, seed)]))


def fingerprint(text: bytes, size: int = SHINGLE, words: int = 1, seed: int = SEED,
                repeats: bool = True) -> list[int]:
    """Signed 64-bit words: a bit is 1 if set in over half the hashes. Without ``repeats`` each
    shingle votes once."""
    n, found = 0, np.zeros((words, 64), np.int64)
    for hashes in shingle_hashes(text, size, seed) if repeats else [shingle_set(text, size, seed)]:
        n += len(hashes)
        found += votes(mixed(hashes, words))
    return np.packbits(2 * found > n, axis=1, bitorder="little").view("<i8").ravel().tolist()


def from_texts(rows: DataFrame, name: str, derive: Callable[[bytes], list[int]]) -> DataFrame:
    """(key columns..., text) to (key columns..., ``name``): 64-bit integers of each text."""
    keys = rows.columns[:-1]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keys)).cast(pa.binary())
            found = [derive(x.as_py() or b"") for x in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(found, pa.list_(pa.int64()))], [*keys, name])

    return rows.mapInArrow(run, f"{schema}, {name} array<long>")


def fingerprints(rows: DataFrame, size: int, words: int, repeats: bool = True) -> DataFrame:
    """(key columns..., text) to (key columns..., f): array of 64-bit words."""
    return from_texts(rows, "f", lambda text: fingerprint(text, size, words, SEED, repeats))


def bounds(segments: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the segments of a 64-bit word."""
    edges = [64 * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def cuts(words: int, segments: int) -> list[Column]:
    """The segments of column ``f`` as structs (first, width, segment)."""
    return [
        F.struct(
            F.lit((word * segments + number) * 64).alias("first"), F.lit(width).alias("width"),
            F.shiftrightunsigned(F.get("f", F.lit(word)), low).bitwiseAND(F.lit((1 << width) - 1))
            .cast("long").alias("segment"))
        for word in range(words) for number, (low, width) in enumerate(bounds(segments))
    ]


def variants(prints: DataFrame, words: int, segments: int) -> DataFrame:
    """(bucket, rest, f) of column ``f``: each segment once per wildcard bit."""
    wildcard = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    return (
        prints.select("f", F.explode(F.array(*cuts(words, segments))).alias("s"))
        .select("f", "s.*", F.explode(F.sequence(F.lit(0), F.col("s.width") - 1)).alias("bit"))
        .select((F.col("first") + F.col("bit")).cast("short").alias("bucket"),
                F.col("segment").bitwiseAND(F.bitwise_not(wildcard)).alias("rest"), "f")
    )


def parts(prints: DataFrame, words: int, segments: int, step: int) -> DataFrame:
    """(part, rest, inside, columns of ``prints``, f first): each segment of f once per run of
    ``step`` bits, which it is split into.

    ``inside`` holds the bits of the run, ``rest`` the segment without them. All variants with
    a wildcard in the run agree in (part, rest), so one row travels for ``step`` of them.
    """
    run = F.call_function("shiftleft", F.lit((1 << step) - 1).cast("long"), F.col("low"))
    inside = F.call_function("shiftrightunsigned", F.col("segment").bitwiseAND(run), F.col("low"))
    return (
        prints.select("*", F.explode(F.array(*cuts(words, segments))).alias("s"))
        .select(*prints.columns, "s.*", F.explode(F.sequence(F.lit(0), F.col("s.width") - 1, F.lit(step))).alias("low"))
        .select((F.col("first") + F.col("low")).cast("short").alias("part"),
                F.col("segment").bitwiseAND(F.bitwise_not(run)).alias("rest"),
                inside.cast("short").alias("inside"), *prints.columns)
    )


def forest(matrix: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links (i, j) that connect all rows within ``distance`` bits, and no more than needed:
    the shortest ones, so that every pair is connected through links no longer than its own."""
    n, at, links = len(matrix), 0, []
    far = matrix.shape[1] * 64 + 1
    apart, nearest = np.full(n, far), np.zeros(n, np.int64)
    outside = np.ones(n, bool)
    for _ in range(n - 1):
        outside[at] = False
        bits = np.bitwise_count(matrix ^ matrix[at]).sum(axis=1, dtype=np.int64)
        closer = outside & (bits < apart)
        apart[closer], nearest[closer] = bits[closer], at
        at = int(np.where(outside, apart, far + 1).argmin())
        if apart[at] <= distance:
            links.append((at, int(nearest[at])))
    return links


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of links, of ``a`` and ``b`` among ``n``, that connect what all connect, without a
    circle: each part takes its first link to another, and what is joined is a part again."""
    root, needed = np.arange(n), [np.zeros(0, np.int64)]
    while len(apart := np.flatnonzero(root[a] != root[b])):
        x, y, first = root[a[apart]], root[b[apart]], np.full(n, len(a))
        np.minimum.at(first, x, apart)
        np.minimum.at(first, y, apart)
        needed.append(np.unique(first[first < len(a)]))
        root = roots(n, root[a[needed[-1]]], root[b[needed[-1]]])[root]
    return np.concatenate(needed)


def bucket_links(words: int, distance: int, most: int):
    """mapInArrow function over rows (bucket, rest, f) sorted by bucket and rest.

    Gives links (a, b) of fingerprints inside a bucket; a bucket of over ``most`` rows gives
    its fingerprints with b null instead. Memory: one batch and the open bucket's ``most``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, large = None, np.zeros((0, words), np.uint64), False

        def table(a: list[np.ndarray], b: list[np.ndarray | None]) -> pa.RecordBatch:
            kind = pa.list_(pa.int64())
            as_list = [pa.array([None if x is None else x.view(np.int64).tolist() for x in side], kind)
                       for side in (a, b)]
            return pa.RecordBatch.from_arrays(as_list, ["a", "b"])

        def closed(rows: np.ndarray, over: bool) -> tuple[list, list]:
            if over:
                return list(rows), [None] * len(rows)
            links = forest(rows, distance) if len(rows) > 1 else []
            return [rows[i] for i, _ in links], [rows[j] for _, j in links]

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            bucket = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            rest = batch.column(1).to_numpy(zero_copy_only=False)
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            f = flat.view(np.uint64).reshape(n, words)
            new = np.ones(n, bool)
            new[1:] = (bucket[1:] != bucket[:-1]) | (rest[1:] != rest[:-1])
            first = (int(bucket[0]), int(rest[0]))
            new[0] = first != key
            starts = np.flatnonzero(new)
            a: list[np.ndarray] = []
            b: list[np.ndarray | None] = []

            def add(rows: np.ndarray, over: bool) -> None:
                x, y = closed(rows, over)
                a.extend(x)
                b.extend(y)

            lead = int(starts[0]) if len(starts) else n
            if lead:  # rows that go on with the open bucket
                held = np.concatenate([held, f[:lead]])
                if large or len(held) > most:
                    add(held, True)
                    held, large = held[:0], True
            if len(starts):
                add(held, large)
                ends = np.append(starts[1:], n)
                size = ends - starts
                pair = starts[:-1][size[:-1] == 2]
                far = np.bitwise_count(f[pair] ^ f[pair + 1]).sum(axis=1, dtype=np.int64)
                a.extend(f[pair[far <= distance]])
                b.extend(f[pair[far <= distance] + 1])
                wide = size[:-1] > 2
                for s, e in zip(starts[:-1][wide].tolist(), ends[:-1][wide].tolist()):
                    add(f[s:e], e - s > most)
                s = int(starts[-1])
                held, large = f[s:].copy(), False
                if len(held) > most:
                    add(held, True)
                    held, large = held[:0], True
            key = (int(bucket[-1]), int(rest[-1]))
            if a:
                yield table(a, b)
        x, y = closed(held, large)
        if x:
            yield table(x, y)

    return run


def first_bucket(a: np.ndarray, b: np.ndarray, segments: int) -> np.ndarray:
    """Number of the first bucket that each pair of fingerprints shares, -1 if none."""
    apart, found = a ^ b, np.full(len(a), -1, np.int64)
    for word in reversed(range(a.shape[1])):
        for number, (low, width) in reversed(list(enumerate(bounds(segments)))):
            differ = (apart[:, word] >> np.uint64(low)) & np.uint64((1 << width) - 1)
            meets = np.bitwise_count(differ) <= 1
            bit = np.bitwise_count(np.where(differ > 0, differ - np.uint64(1), differ)).astype(np.int64)
            found[meets] = (word * segments + number) * 64 + bit[meets]
    return found


def group_links(words: int, segments: int, distance: int, step: int, keys: int = 2, most: int | None = None):
    """mapInArrow function over rows (part, rest, [cell,] inside, f) sorted by the ``keys`` columns
    in front.

    Rows of one key are the group of ``step`` wildcards; the bucket of each wildcard
    is found among them by the other bits inside. Gives links (a, b) of fingerprints of a group that
    connect all pairs in a bucket within the distance. A pair counts only in the first bucket that its ends share: in a later
    one they are connected already. So members that meet in hundreds of buckets are not linked anew
    in each. Buckets of up to ``FEW`` rows are compared together, without a step for each bucket: chance
    alone makes their number grow with the square of the rows. A group of over ``most`` rows gives its
    rows with b null instead. Memory: one batch and the open group, ``most`` at most.
    """

    def listed(f: np.ndarray) -> pa.Array:
        ends = np.arange(len(f) + 1, dtype=np.int32) * words
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(f.view(np.int64).ravel()))

    def table(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        n, none = len(a), pa.nulls
        return pa.RecordBatch.from_arrays(
            [listed(np.ascontiguousarray(a)), listed(np.ascontiguousarray(b)), none(n, pa.int16()),
             none(n, pa.int64()), none(n, pa.int16())], CROWDED_NAMES)

    def crowd(columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        part, rest, _, inside, f = columns
        return pa.RecordBatch.from_arrays(
            [listed(f), pa.nulls(len(f), pa.list_(pa.int64())), pa.array(part.astype(np.int16)), pa.array(rest),
             pa.array(inside.astype(np.int16))], CROWDED_NAMES)

    def near(f: np.ndarray, i: np.ndarray, j: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs of a bucket that are within the distance, and share no bucket before."""
        bits = np.zeros(len(i), np.uint16)
        for word in range(words):
            bits += np.bitwise_count(f[i, word] ^ f[j, word])
            if word == words // 2 and words > 2:  # most that are apart are so in half the words
                some = bits <= distance
                i, j, bits, bucket = i[some], j[some], bits[some], bucket[some]
        some = bits <= distance
        i, j, bucket = i[some], j[some], bucket[some]
        some = first_bucket(f[i], f[j], segments) == bucket
        return i[some], j[some]

    def linked(part: np.ndarray, group: np.ndarray, inside: np.ndarray, f: np.ndarray) -> Iterator[tuple]:
        """Pairs of rows, numbered: all that are near in a bucket of few rows, the shortest that connect it in others."""
        for bit in range(step):
            bucket = group << step | inside & ~(1 << bit)
            order = np.argsort(bucket, kind="stable")
            at = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            size = np.diff(at, append=len(order))
            few = np.repeat(np.where(size <= FEW, at + size, 0), size)  # where a row's bucket ends
            for d in range(1, min(FEW, int(size.max()))):
                i = np.flatnonzero(few > np.arange(d, len(order) + d))
                if not len(i):
                    break
                i, j = order[i], order[i + d]
                yield near(f, i, j, part[i] + bit)
            for s, n in zip(at[size > FEW].tolist(), size[size > FEW].tolist()):
                rows = order[s: s + n]
                links = rows[np.array(forest(f[rows], distance), np.int64).reshape(-1, 2)]
                yield near(f, links[:, 0], links[:, 1], part[links[:, 0]] + bit)

    def joined(links: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Those of the links that are needed to connect what all connect."""
        a, b = (np.concatenate(side) for side in zip(*links))
        nodes, number = np.unique(np.concatenate([a, b]), return_inverse=True)
        needed = spanning(len(nodes), number[: len(a)], number[len(a):])
        return a[needed], b[needed]

    def closed(pieces: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        """Links of whole groups."""
        part, rest, cell, inside, f = (np.concatenate(c) for c in zip(*pieces))
        new = np.ones(len(part), bool)
        new[1:] = (part[1:] != part[:-1]) | (rest[1:] != rest[:-1]) | (cell[1:] != cell[:-1])
        group = np.cumsum(new)
        size = np.bincount(group)[group]
        if most is not None and (size > most).any():
            yield crowd(tuple(x[size > most] for x in (part, rest, cell, inside, f)))
        shared = (size > 1) & (size <= (most or size))
        if shared.any():
            held, n, f = [], 0, f[shared]
            for links in linked(part[shared], group[shared], inside[shared], f):
                held.append(links)
                n += len(links[0])
                if n >= PIECE:
                    held, n = [joined(held)], 0
            if held and any(len(a) for a, _ in held):
                a, b = joined(held)
                yield table(f[a], f[b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[tuple[np.ndarray, ...]] = []
        over = False  # the open group is crowded: its rows go out as they come
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            number = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(keys + 1)]
            part, rest, inside = number[0], number[1], number[keys]
            cell = number[2] if keys > 2 else np.zeros(n, np.int64)
            f = batch.column(keys + 1).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, words)
            columns = (part, rest, cell, inside, f)
            last = (part == part[-1]) & (rest == rest[-1]) & (cell == cell[-1])
            start = int(np.argmax(last))  # of the group left open
            same = bool(pieces) and tuple(x[-1] for x in pieces[-1][:3]) == (part[0], rest[0], cell[0])
            if over and same:
                again = (part == part[0]) & (rest == rest[0]) & (cell == cell[0])
                lead = n if again.all() else int(np.argmin(again))
                yield crowd(tuple(x[:lead] for x in columns))
                if lead == n:
                    continue
                columns, start = tuple(x[lead:] for x in columns), start - lead
            if over:
                pieces, over = [], False
            if start or pieces and not same:
                pieces.append(tuple(x[:start] for x in columns))
                yield from closed(pieces)
                pieces = []
            pieces.append(tuple(x[start:].copy() for x in columns))
            if most is not None and sum(len(x[0]) for x in pieces) > most:
                yield crowd(tuple(np.concatenate(c) for c in zip(*pieces)))
                pieces, over = [tuple(x[-1:] for x in pieces[-1])], True
        if pieces and not over:
            yield from closed(pieces)

    return run


def neighbour_links(crowded: DataFrame) -> DataFrame:
    """Links of all one-word fingerprints ``f`` within 2 bits: to the least one that shares
    a neighbour. At most 65 fingerprints share one."""
    near = F.array(F.get("f", F.lit(0)), *[
        F.get("f", F.lit(0)).bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0))) for i in range(64)])
    return (
        crowded.distinct().select("f", F.explode(near).alias("near"))
        .groupBy("near").agg(F.min("f").alias("b"), F.collect_set("f").alias("all"))
        .where(F.size("all") > 1)
        .select(F.explode("all").alias("a"), "b").where(F.col("a") != F.col("b")).distinct()
    )


def met_in_groups(prints: DataFrame, words: int, segments: int, distance: int) -> DataFrame:
    """Links (a, b), a > b, of fingerprints ``f`` that share a bucket: enough to connect them.

    Groups of over ``CROWD`` rows are dealt in blocks, and every two blocks meet in a task: the
    shortest links of the whole are among the shortest links of the parts.
    """
    tasks = max(prints.sparkSession.sparkContext.defaultParallelism, -(-prints.count() // SPREAD))
    split = parts(prints.repartition(tasks), words, segments, STEP)
    met = cut(
        split.repartition("part", "rest").sortWithinPartitions("part", "rest")
        .mapInArrow(group_links(words, segments, distance, STEP, 2, CROWD), CROWDED_SCHEMA))
    crowded = met.where("b IS NULL").select("part", "rest", "inside", F.col("a").alias("f"))
    blocks = hinted(cut(crowded.groupBy("part", "rest").agg(
        F.ceil(F.count("*") / F.lit(CROWD / 2)).cast("int").alias("blocks"))))
    mine, other = F.pmod(F.xxhash64("f"), F.col("blocks")).cast("int"), F.col("other")
    cells = (
        crowded.join(blocks, ["part", "rest"]).withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("mine <> other")
        .select("part", "rest", (F.least("mine", other).cast("long") * F.col("blocks") + F.greatest("mine", other))
                .alias("cell"), "inside", "f")
        .repartition("part", "rest", "cell").sortWithinPartitions("part", "rest", "cell")
        .mapInArrow(group_links(words, segments, distance, STEP, 3), CROWDED_SCHEMA)
    )
    both = met.where("b IS NOT NULL").unionByName(cells)
    return both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def links_of(distinct: DataFrame, words: int, segments: int, distance: int) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``f`` found within ``distance``.

    Of a distance of 2 in one word, crowded buckets are linked through neighbours.
    """
    prints, links = distinct.select("f"), "a array<long>, b array<long>"
    if (words, distance) != (1, 2):
        return met_in_groups(prints, words, segments, distance)
    met = cut(
        variants(prints, words, segments)
        .repartition("bucket", "rest").sortWithinPartitions("bucket", "rest")
        .mapInArrow(bucket_links(words, distance, BUCKET_ROWS), links).distinct())
    crowded = met.where("b IS NULL").select(F.col("a").alias("f"))
    return met.where("b IS NOT NULL").unionByName(neighbour_links(crowded))


def near_fingerprints(documents: DataFrame, size: int = SHINGLE, id_column: str = "doc_id",
                      text_column: str = "text") -> DataFrame:
    """Every row with its fingerprint (16 hex digits) and the least doc_id of its class."""
    marked = cut(fingerprints(wanted(documents, doc_id=id_column, text=text_column), size, 1))
    distinct = cut(marked.groupBy("f").agg(F.min("doc_id").alias("least")))
    classes = components(links_of(distinct.select("f"), 1, SEGMENTS, DISTANCE))
    rooted = distinct.join(classes.withColumnRenamed("node", "f"), "f", "left").withColumn(
        "root", F.coalesce("root", "f"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_f = rooted.join(ids, "root").select("f", "component_id")
    return marked.join(by_f, "f").select(
        "doc_id", F.lpad(F.lower(F.hex(F.get("f", F.lit(0)))), 16, "0").alias("fingerprint"), "component_id")


def alike(sets: list[np.ndarray], side: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links (i, j) that connect the sets of at least that Jaccard similarity: one for each two
    classes that meet. Sets of different sides are compared if both sides occur, else all.

    The sets' elements are numbered once; a set is then met with all that are not yet of its
    class, and of a size that allows it, by adding up its marks over their numbers.
    """
    n, links = len(sets), []
    size = np.array([len(x) for x in sets], np.int64)
    _, number = np.unique(np.concatenate([np.zeros(0, np.int64), *sets]), return_inverse=True)
    ends = np.cumsum(size)
    starts = ends - size
    marks = np.zeros(int(number.max()) + 1 if len(number) else 1, bool)
    root = np.arange(n)
    apart = side.min() != side.max() if n else False
    for i in range(n - 1):
        j = np.arange(i + 1, n)
        j = j[(root[j] != root[i]) & (np.minimum(size[j], size[i]) >= np.maximum(size[j], size[i]) * similarity)]
        if apart:
            j = j[side[j] != side[i]]
        if not len(j):
            continue
        own = number[starts[i]: ends[i]]
        marks[own] = True
        length = size[j]
        # the numbers of the sets j, one after the other
        at = np.repeat(starts[j] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        hits = np.concatenate([[0], np.cumsum(marks[number[at]])])
        last = np.cumsum(length)
        shared = hits[last] - hits[last - length]
        marks[own] = False
        # in whole shares of the union, as 4 of 5 is exactly 0.8
        for k in j[shared >= (size[i] + length - shared) * similarity].tolist():
            if root[k] != root[i]:
                links.append((i, k))
                root[root == root[k]] = root[i]
    return links


def verified(words: int, similarity: float):
    """mapInArrow function over rows (kin, cell, side, f, shingles) sorted by kin and cell: links
    (a, b) of the fingerprints whose sets are alike. Memory: one batch and the open cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def closed() -> pa.RecordBatch | None:
            f = [x for x, _, _ in held]
            links = alike([x for _, _, x in held], np.array([x for _, x, _ in held], np.int64), similarity)
            if not links:
                return None
            kind = pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array([f[i] for i, _ in links], kind), pa.array([f[j] for _, j in links], kind)], ["a", "b"])

        for batch in batches:
            kin, cell, side, f = (batch.column(i).to_pylist() for i in range(4))
            flat = batch.column(4).flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.array(pc.list_value_length(batch.column(4)).to_pylist(), np.int64))
            for i in range(batch.num_rows):
                if (kin[i], cell[i]) != key:
                    found = closed()
                    if found is not None:
                        yield found
                    key, held = (kin[i], cell[i]), []
                held.append((f[i], side[i], flat[ends[i - 1] if i else 0: ends[i]].copy()))
        found = closed()
        if found is not None:
            yield found

    return run


def similar_within(members: DataFrame, similarity: float, block_bytes: int | None = None,
                   block_rows: int | None = None) -> DataFrame:
    """Links (a, b) between fingerprints of one kin whose shingle sets have at least that Jaccard
    similarity: enough to connect all such pairs.

    ``members``: (kin, f, shingles). A kin is dealt in blocks of bounded size, of which every two
    meet in a task (and each by itself): every pair of the kin is compared there, each set
    travels once for every block, and a task gives only links that join what was apart.
    """
    block_bytes, block_rows = block_bytes or BLOCK_BYTES, block_rows or BLOCK_ROWS
    sizes = members.groupBy("kin").agg(F.count("*").alias("n"), F.sum(F.size("shingles")).alias("numbers"))
    blocks = cut(sizes.where("n > 1").select("kin", F.greatest(
        F.ceil(F.col("n") / F.lit(float(block_rows))), F.ceil(F.col("numbers") * 8 / F.lit(float(block_bytes)))
    ).cast("int").alias("blocks")))
    mine, other, blocks_of = F.col("mine"), F.col("other"), F.col("blocks")
    dealt = (
        members.join(blocks, "kin").withColumn("mine", F.pmod(F.xxhash64("f"), blocks_of).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks_of - 1)))
        .select(F.xxhash64("kin").alias("kin"), (F.least(mine, other).cast("long") * blocks_of + F.greatest(mine, other)).alias("cell"),
                F.col("mine").alias("side"), "f", "shingles")
    )
    return (
        dealt.repartition("kin", "cell").sortWithinPartitions("kin", "cell")
        .mapInArrow(verified(STAGE_WORDS, similarity), "a array<long>, b array<long>"))


def in_classes(rows: DataFrame, classes: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with the root of ``column`` as ``name``: itself, if it is in no link."""
    side = classes.select(F.col("node").alias(column), F.col("root").alias("__root"))
    return rows.join(side, column, "left").select(*rows.columns, F.coalesce("__root", column).alias(name))


def near_classes(distinct: DataFrame, texts: DataFrame) -> DataFrame:
    """(f, least, root): the class of every distinct fingerprint.

    ``distinct``: (f, least), ``least`` naming a row of ``texts`` (row id, row hash, text).
    """
    links = links_of(distinct.select("f"), STAGE_WORDS, STAGE_SEGMENTS, STAGE_DISTANCE)
    met = cut(components(links))
    named = met.select(F.col("node").alias("f"), F.col("root").alias("kin")).join(distinct, "f").select(
        "kin", "f", f"least.{ROW_ID}", f"least.{ROW_HASH}")
    found = named.join(texts, [ROW_ID, ROW_HASH]).dropDuplicates(["f"]).select("kin", "f", texts.columns[-1])
    members = cut(from_texts(found, "shingles", lambda text: shingle_set(text, STAGE_SHINGLE).view("<i8").tolist()))
    held = components(similar_within(members, SIMILARITY))
    return in_classes(distinct.select("f", "least"), held, "f", "root")


def keep_one(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents, less all but the first (by doc_id) of each class of near-duplicates."""
    rows = keyed(documents, id_column, text_column)
    texts = rows.select(ROW_ID, ROW_HASH, F.col(f"`{text_column}`"))
    marked = fingerprints(texts, STAGE_SHINGLE, STAGE_WORDS, repeats=False)
    distinct = cut(marked.groupBy("f").agg(F.min(F.struct(ROW_ID, ROW_HASH)).alias("least")))
    first = (
        near_classes(distinct, texts).groupBy("root").agg(F.min("least").alias("least"))
        .select(f"least.{ROW_ID}", f"least.{ROW_HASH}")
    )
    one = Window.partitionBy(ROW_ID, ROW_HASH).orderBy(ROW_ID)
    return (
        rows.join(first, [ROW_ID, ROW_HASH]).withColumn("__copy", F.row_number().over(one))
        .where("__copy = 1").select(*[F.col(f"`{c}`") for c in documents.columns])
    )
