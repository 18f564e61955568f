"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated
rows, empty tables and clashing column names."""

import hashlib
import itertools
import math
import pickle
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from hemicycle.llm import (
    ann, blocks, components, language, line_dedup, mixing, packing, simhash, suffix_dedup, topk, toxicity, url_filter,
)
from hemicycle.llm.queries import TOKENIZER

RNG = np.random.default_rng(5)
WORDS = ["ba", "be", "bi", "bo", "bu", "da", "de", "di", "do", "du", "Ga", "ge.", "gi,", "é", "go"]
COMMON = " ".join(RNG.choice(WORDS, 40))
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, host string, rank int, score string, __row int, w int"


def sentence(n):
    return " ".join(RNG.choice(WORDS, n))


def rows_of(texts):
    return [(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), "h", 1, "x", 2, 3) for i, t in texts]


@pytest.fixture(scope="module")
def texts():
    out = [(i, "\n".join(sentence(int(RNG.integers(1, 25))) for _ in range(int(RNG.integers(1, 7))))) for i in range(60)]
    out += [(100 + i, t) for i, t in out[:8]]  # copies
    out += [(200 + i, sentence(5) + " " + COMMON + " " + sentence(4)) for i in range(8)]
    out += [(300, None), (301, ""), (302, "   \n\n\n\n"), (None, out[3][1]), (303, "ba " * 40_000), (304, "aaaa" * 200)]
    return out + [(7, out[7][1]), (7, "another text with the same id " + COMMON)]


@pytest.fixture(scope="module")
def documents(spark, texts):
    return spark.createDataFrame(rows_of(texts), EXTRA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], EXTRA)


@pytest.fixture(scope="module")
def vectors(spark):
    base = RNG.normal(size=(300, 12))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    base[40:90] = base[40]  # ties
    rows = [(i, v.tolist(), 1, 0.5) for i, v in enumerate(base)]
    rows += [(1000, None, 1, 0.5), (1001, [], 1, 0.5), (1002, [float("nan")] * 12, 1, 0.5), (None, [1.0] * 12, 1, 0.5),
             (1003, [float("inf")] + [0.0] * 11, 1, 0.5), (1100, [0.0] * 12, 1, 0.5), (1200, [1.0, 2.0], 1, 0.5),
             (1201, [3.0, -2.0], 1, 0.5), (5, rows[5][1], 1, 0.5)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score double").repartition(3)


def valid(vectors, zero):
    out = []
    for r in vectors.collect():
        v = r.embedding
        if r.vec_id is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v)):
            out.append((r.vec_id, v))
    return out


def brute(rows, every, k, score):
    want = []
    for q in sorted({i for i, _ in rows if i % every == 0}):
        qv = min(v for i, v in rows if i == q)
        found = sorted((-score(qv, v), i) for i, v in rows if i != q and len(v) == len(qv))[:k]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return want


def test_topk_matches_brute_force(vectors):
    def score(a, b):
        return sum(math.floor(1024 * x) * math.floor(1024 * y) for x, y in zip(a, b))

    want = brute(valid(vectors, True), 20, 10, score)
    assert sorted(map(tuple, topk.top_k(vectors, 10, 20).collect())) == sorted(want)
    assert topk.top_k(vectors.limit(0)).count() == 0


def test_bit_slices_add_and_select():
    values = RNG.integers(-500, 500, (130, 7))
    ids = np.arange(130)
    block = topk.build_slices(ids, values / 1024)
    query = topk.pack_queries(np.array([-1]), RNG.integers(-900, 900, (1, 7)) / 1024)
    q, rows, score = topk.meet_top(130)(query, block)
    assert dict(zip(rows.tolist(), score.tolist())) == dict(enumerate((values @ pickle.loads(query)[1][0]).tolist()))


def test_topk_of_numbers_of_any_size(spark):
    rows = [(i, RNG.normal(size=3).tolist()) for i in range(60)]
    for i, v in rows:
        v[i % 3] = float(RNG.choice([2.0**18, -1e6 - 0.3, 3e5] if i % 20 == 0 else [2.0**21 + 0.5, -2e6, 2.0**18, 1e-300]))
    rows += [(100, [0.25, 0.0, -1.0]), (101, [0.0, 0.0, 0.0]), (103, [-(2.0**22), 0.0, 1.0])]

    def score(a, b):
        return sum(math.floor(Fraction(x) * 1024) * math.floor(Fraction(y) * 1024) for x, y in zip(a, b))

    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, 20, 4, score)
    assert any(abs(s) > 1 << 55 for *_, s in want)
    assert sorted(map(tuple, topk.top_k(table, 4, 20).collect())) == sorted(want)
    huge = [1e300, 0.0, 0.0]
    # of the largest, only scores that are no longs fail
    lone = spark.createDataFrame([(100, huge), (101, [0.0, 5.0, 0.0])], table.schema)
    assert [r["score"] for r in topk.top_k(lone, 1, 100).collect()] == [0]
    for other in (1e300, -1e300):
        over = spark.createDataFrame([(100, huge), (101, [other, 0.0, 0.0])], table.schema)
        with pytest.raises(Exception, match="among the best"):
            topk.top_k(over, 1, 100).collect()


def test_votes_find_the_near_rows_of_large_blocks():
    points = RNG.normal(size=(6000, 48))
    asked = points[:50] + RNG.normal(size=(50, 48))
    pack = ann.build_index(ann.TABLES)
    _, _, buckets = pickle.loads(pack(np.arange(6000), points))
    chosen = ann.candidates(ann.votes(ann.unit(asked), buckets, ann.PROBES), 600)
    assert (chosen.sum(axis=1) < 700).all()
    near = np.argsort(-(asked @ points.T), axis=1)[:, :20]
    assert chosen[np.arange(50)[:, None], near].mean() >= 0.9
    # no row of equal votes is left out
    same = ann.candidates(np.zeros((2, 30), np.float32), 10)
    assert same.all()


def test_blocks_are_even_and_tasks_bounded(spark, vectors, monkeypatch):
    whole = sorted(map(tuple, topk.top_k(vectors, 10, 20).collect()))
    monkeypatch.setattr(blocks, "INDEX_ROWS", 16)
    monkeypatch.setattr(blocks, "QUERY_ROWS", 2)
    monkeypatch.setattr(blocks, "MOST_TASKS", 5)
    assert sorted(map(tuple, topk.top_k(vectors.repartition(50), 10, 20).collect())) == whole


def test_nearest_has_recall_and_exact_scores(vectors):
    def score(a, b):
        total = 0.0
        for x, y in zip(a, b):
            total += x * y
        return total

    rows = valid(vectors, False)
    want = brute(rows, 20, 20, score)
    got = [tuple(r) for r in ann.nearest(vectors, 20, 20).collect()]
    assert len(got) == len(want)
    assert len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) >= 0.9 * len(want)
    lookup = defaultdict(list)
    for i, v in rows:
        lookup[i].append(v)
    assert all(any(s == score(min(lookup[q]), v) for v in lookup[i]) for q, _, i, s in got)
    assert ann.nearest(vectors.limit(0)).count() == 0


def test_hadamard_is_orthonormal():
    x = RNG.normal(size=(5, 16))
    assert np.allclose(ann.hadamard(ann.hadamard(x)), x)
    assert np.allclose(np.linalg.norm(ann.rotate(x, 3), axis=1), np.linalg.norm(x, axis=1))


def test_toxicity_learns_words_and_finds_sentences(spark):
    rows, labels = [], []
    for i in range(400):
        body = [sentence(6) for _ in range(4)]
        if i % 4 == 0:
            body[i % 3] += " grumblefoo" if i % 8 else " snarkword"
        rows.append((i, ". ".join(body), "en", "s", 1, "h", 1, "x", 2, 3))
        labels.append((i, int(i % 4 == 0)))
    rows += rows_of([(1000, None), (1001, ""), (None, "grumblefoo"), (3, rows[3][1]), (1002, "ba. " * 30_000)])
    labels += [(2000, None), (None, 1), (4, 1)]
    docs = spark.createDataFrame(rows, EXTRA)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    found = toxicity.find_toxic(docs, known).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    for i in range(400):
        assert by_id[i].predicted == int(i % 4 == 0)
        assert by_id[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    span = by_id[8].offending[0]
    assert "snarkword" in rows[8][1][span.start:span.end] and len(by_id[8].offending) == 1
    assert by_id[None].predicted == 1 and by_id[1000].predicted == 0 == by_id[1001].predicted
    assert all(0 <= r.score <= 1 for r in found)
    bare = toxicity.find_toxic(docs, known.limit(0))
    assert {r.score for r in bare.select("score").distinct().collect()} == {0.0}
    assert toxicity.find_toxic(docs.limit(0), known).count() == 0


def test_language_uses_text_and_priors(spark):
    en, de = "the house and the tree are over there ", "das haus und der baum sind dort drüben "
    rows = [(i, (en if i % 2 else de) * (1 + i % 5), "en" if i % 2 else "de", "a" if i % 2 else "b", 1, "h", 1, "x", 2, 3)
            for i in range(80)]
    rows += rows_of([(900, None), (901, ""), (902, "12345 $$$"), (None, en), (3, rows[3][1]), (903, de * 20_000)])
    docs = spark.createDataFrame(rows, EXTRA)
    kept = language.keep_identified(docs).collect()
    ids = [r.doc_id for r in kept]
    assert set(range(80)) <= set(ids) and not {900, 901, 902} & set(ids) and ids.count(3) == 2 and None in ids
    assert {r.lang for r in kept if r.doc_id == 903} == {"de"} and kept[0].asDict().keys() == set(docs.columns)
    assert all(r.lang == ("en" if r.doc_id % 2 else "de") for r in kept if r.doc_id is not None and r.doc_id < 80)
    pages = spark.createDataFrame(
        [(1, "http://x.de/de/902", "<html lang='de'>"), (2, None, None), (3, "no scheme", "")],
        "page_id long, url string, html string")
    judged = {r.doc_id: r for r in language.identify_documents(docs, pages).collect()}
    assert judged[902].language == "de" and not judged[902].kept and judged[1].language == "en"
    assert language.keep_identified(docs.limit(0)).count() == 0


def test_markup_language_is_found_anywhere(spark):
    """A long comment, white space or attributes before lang= take nothing away."""
    late = [f"<!-- {'x' * 5000} --><html lang='de'>", " " * 3000 + "<HTML LANG=de>", f"<html class='{'y' * 2000}' lang=\"de\">"]
    pages = spark.createDataFrame([(i, f"http://x.com/{i}", html) for i, html in enumerate(late)],
                                  "page_id long, url string, html string")
    assert [r.declared for r in language.page_evidence(pages).collect()] == ["de"] * 3


def test_packing_round_trip_and_bins(documents, texts, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    odd = [(400, "It's <|endoftext|> ÀÉ İstanbul Σίσυφος, a\u0301 x\t\u00a0y ...,ok don't"), (401, "word" * 3000)]
    docs = documents.sparkSession.createDataFrame(rows_of(texts + odd), EXTRA)
    rows = packing.pack(docs, TOKENIZER, with_ids=True).collect()
    want = sorted([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for _, t in texts + odd)
    pieces = defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length <= 2048
        pieces[r.sequence_id].append((r.offset, r.length))
    whole = sorted([r for r in rows if r.piece == 0], key=lambda r: r.length)
    assert len(whole) == len(texts + odd)
    assert sorted(x for r in rows for x in r.ids) == sorted(x for w in want for x in w)
    short = sorted(list(r.ids) for r in rows if r.length < 2048 and r.piece == 0)
    assert short == [w for w in want if len(w) < 2048]
    for places in pieces.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert packing.pack(empty, TOKENIZER).count() == 0


def test_open_bins_fit_best_and_close_the_fullest():
    bins = packing.OpenBins(10, 2, 0)
    assert [bins.place(x) for x in (6, 5, 4, 5, 10, 3)] == [(0, 0), (1, 0), (0, 6), (1, 5), (2, 0), (3, 0)]
    bins.place(8)  # opens a second bin
    assert bins.place(9)[0] == 5 and bins.open == 2  # bin 4 (2 free) closed, bin 3 (7 free) stays
    assert bins.place(7) == (3, 3)


def test_line_dedup_matches_brute_force(documents, texts, empty):
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in line_dedup.dedup_lines(documents).collect()), key=repr)
    seen, covered = {}, defaultdict(set)
    keyed = {(line_dedup.LAST if i is None else i, xxhash.xxh64_intdigest(t.encode(), 42), t)
             for i, t in texts if t is not None}
    signed = sorted((i, h - (1 << 64) if h >> 63 else h, t) for i, h, t in keyed)
    for i, h, t in signed:
        lines = t.split("\n")
        for p in range(len(lines) - 2):
            if tuple(lines[p:p + 3]) in seen:
                covered[i, t] |= {p, p + 1, p + 2}
            seen.setdefault(tuple(lines[p:p + 3]), (i, p))
    want = []
    for i, t in texts:
        gone = covered[line_dedup.LAST if i is None else i, t]
        want.append((i, t if not gone else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone), len(gone)))
    assert got == sorted(want, key=repr)
    assert line_dedup.dedup_lines(empty).count() == 0


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_of(prints, distance):
    root = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    return root


def test_simhash_matches_brute_force(documents, texts, empty):
    prints = [fingerprint(t) for _, t in texts]
    root = classes_of(prints, 2)
    least = {r: min([i for (i, _), x in zip(texts, root) if x == r and i is not None], default=None) for r in root}
    want = [(i, f"{f:016x}", least[r]) for (i, _), f, r in zip(texts, prints, root)]
    got = [tuple(r) for r in simhash.near_fingerprints(documents).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert simhash.near_fingerprints(empty).count() == 0


@pytest.mark.parametrize("crowd", [3, 200])
def test_links_of_crowded_buckets(spark, crowd):
    """Fingerprints that share a segment, more than a bucket compares pair by pair."""
    high = int(RNG.integers(1 << 31)) << 32
    prints = list({high | int(x) for x in RNG.integers(0, 1 << 10, crowd)})
    signed = [[f - (1 << 64) if f >> 63 else f] for f in prints]
    rows = spark.createDataFrame([(s,) for s in signed], "f array<long>")
    links = simhash.links_of(rows, 1, 2, 2)
    root = {tuple(r.node): tuple(r.root) for r in components.components(links).collect()}
    mine = defaultdict(set)
    for s in signed:
        mine[root.get(tuple(s), tuple(s))].add(tuple(s))
    want = defaultdict(set)
    for s, r in zip(signed, classes_of(prints, 2)):
        want[r].add(tuple(s))
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def flipped(f, bits):
    for b in RNG.choice(256, bits, replace=False).tolist():
        f = [w ^ (1 << (b % 64)) if i == b // 64 else w for i, w in enumerate(f)]
    return f


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_links_of_long_fingerprints(spark, batch):
    """Classes of all pairs that share a variant within the distance, groups over many batches."""
    words, segments, distance = 4, 3, 52
    base = [[int(x) for x in RNG.integers(0, 1 << 63, 4)] for _ in range(12)]
    prints = base + [flipped(base[i % 3], int(RNG.integers(1, 70))) for i in range(60)]
    signed = [tuple(w - (1 << 64) if w >> 63 else w for w in f) for f in prints]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        links = simhash.links_of(spark.createDataFrame([(list(f),) for f in signed], "f array<long>"),
                                 words, segments, distance).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

    def meet(x, y):
        return any((((x[w] ^ y[w]) >> low) & ((1 << width) - 1)).bit_count() <= 1
                   for w in range(words) for low, width in simhash.bounds(segments))

    def apart(x, y):
        return sum((a ^ b).bit_count() for a, b in zip(x, y))

    by_print = dict(zip(signed, prints))
    wanted = [(x, y) for x, y in itertools.combinations(prints, 2) if apart(x, y) <= distance and meet(x, y)]
    given = [(by_print[tuple(r.a)], by_print[tuple(r.b)]) for r in links]
    assert all(apart(x, y) <= distance and meet(x, y) for x, y in given)

    def roots(pairs):
        root = {tuple(f): i for i, f in enumerate(prints)}
        for _ in prints:
            for x, y in pairs:
                root[tuple(x)] = root[tuple(y)] = min(root[tuple(x)], root[tuple(y)])
        return root

    assert roots(given) == roots(wanted) and len(wanted) > 60


def in_groups(prints, words, segments, step):
    """Rows (part, rest, inside, f) of whole fingerprints, sorted, as batches."""
    rows = sorted(
        (64 * (word * segments + number) + at, seg & ~run, (seg & run) >> at, f)
        for f in prints for word in range(words) for number, (low, width) in enumerate(simhash.bounds(segments))
        for seg in [(f[word] >> low) & ((1 << width) - 1)] for at in range(0, width, step)
        for run in [((1 << step) - 1) << at])
    signed = [[w - (1 << 64) if w >> 63 else w for w in f] for *_, f in rows]
    columns = [pa.array([r[0] for r in rows], pa.int16()), pa.array([r[1] for r in rows], pa.int64()),
               pa.array([r[2] for r in rows], pa.int16()), pa.array(signed, pa.list_(pa.int64()))]
    return pa.Table.from_arrays(columns, names=["part", "rest", "inside", "f"]).to_batches(500)


@pytest.mark.parametrize("few", [64, 4])
def test_buckets_that_meet_by_chance_are_compared_together(monkeypatch, few):
    """Many buckets of a few fingerprints: no search for shortest links in each of them."""
    words, segments, distance, step, rng = 3, 8, 48, 4, np.random.default_rng(5)
    prints = [tuple(int(x) for x in rng.integers(0, 1 << 64, words, dtype=np.uint64)) for _ in range(600)]
    for f in prints[:30]:
        for _ in range(4):
            prints.append(tuple(w ^ (1 << int(b)) ^ (1 << int(c)) for w, b, c in zip(f, *rng.integers(0, 64, (2, words)))))
    searched, forest = [], simhash.forest
    monkeypatch.setattr(simhash, "FEW", few, raising=False)
    monkeypatch.setattr(simhash, "forest", lambda rows, most: searched.append(len(rows)) or forest(rows, most))
    found = simhash.group_links(words, segments, distance, step)(iter(in_groups(prints, words, segments, step)))
    number = {f: i for i, f in enumerate(prints)}
    a, b = ([number[tuple(x % (1 << 64) for x in f)] for t in tables for f in t] for tables in zip(
        *([t.column(0).to_pylist(), t.column(1).to_pylist()] for t in found)))
    matrix = np.array(prints, np.uint64)
    apart = np.bitwise_count(matrix[:, None] ^ matrix[None]).sum(axis=2)
    close = np.argwhere((apart <= distance) & (apart > 0))
    assert {tuple(sorted(x)) for x in zip(a, b)} <= {tuple(sorted(x)) for x in close.tolist()}
    n = len(prints)
    assert (components.roots(n, np.array(a), np.array(b)) == components.roots(n, close[:, 0], close[:, 1])).all()
    assert not searched if few == 64 else all(x > few for x in searched)


def test_groups_without_a_shared_bucket_give_no_links():
    """Two fingerprints of a group whose bits inside differ by two."""
    rows = in_groups([(0,), (3,)], 1, 2, 4)
    assert sum(t.num_rows for t in simhash.group_links(1, 2, 1, 4)(iter(rows))) == 0
    only = [r for r in pa.Table.from_batches(rows).slice(0, 2).to_batches() if r.num_rows]
    assert not list(simhash.group_links(1, 2, 1, 4)(iter(only)))


def test_spanning_links_connect_what_all_connect():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n, k = int(rng.integers(1, 30)), int(rng.integers(0, 60))
        a, b = rng.integers(0, n, (2, k))
        needed, root = simhash.spanning(n, a, b), components.roots(n, a, b)
        assert len(needed) == n - len(set(root.tolist()))
        assert (components.roots(n, a[needed], b[needed]) == root).all()


def test_keep_one_leaves_one_of_each_group(spark, empty):
    base = [sentence(120) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t) for i, t in enumerate(base[:5])]
    rows += [(200 + i, t + " zu") for i, t in enumerate(base[:5])] + [(0, base[0]), (None, base[1]), (500, None), (501, "")]
    kept = simhash.keep_one(spark.createDataFrame(rows_of(rows), EXTRA))
    assert sorted(r.doc_id for r in kept.collect()) == [*range(12), 500] and kept.columns == EXTRA_NAMES
    assert simhash.keep_one(empty).count() == 0


def jaccard(a, b):
    x, y = ({tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_keep_one_links_by_exact_similarity(spark):
    """Two-text groups over the whole range: those under 0.8 stay, most of the others go."""
    rows, near, far = [], [], []
    for i in range(120):
        one = sentence(80 + i).split()
        two = list(one)
        for at in RNG.choice(len(one), 1 + i % 5, replace=False):
            two[at] = f"neu{i}x{at}"
        group = (" ".join(one), " ".join(two))
        rows += [(2 * i, group[0]), (2 * i + 1, group[1])]
        (near if jaccard(*group) >= 0.8 else far).append(2 * i + 1)
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows_of(rows), EXTRA)).collect()}
    assert {2 * i for i in range(120)} <= kept and set(far) <= kept
    assert len(near) > 40 and len(far) > 20
    assert sum(i not in kept for i in near) >= 0.9 * len(near)


def test_close_fingerprints_are_verified_too(spark):
    """Short texts under 0.8 whose few shingles change few bits: both stay."""
    rng, pairs = np.random.default_rng(11), []
    while len(pairs) < 5:
        base = [f"wort{x}" for x in rng.integers(0, 10**9, 12)]
        pair = [" ".join(base), " ".join([*base[:-1], "anders"])]
        f, g = (simhash.fingerprint(t.encode(), 5, simhash.STAGE_WORDS, repeats=False) for t in pair)
        if 0 < sum(((x ^ y) % (1 << 64)).bit_count() for x, y in zip(f, g)) <= 24:
            pairs.append(pair)
    texts = [t for pair in pairs for t in pair]
    assert all(jaccard(*pair) < 0.8 for pair in pairs)
    assert simhash.keep_one(spark.createDataFrame(rows_of(list(enumerate(texts))), EXTRA)).count() == len(texts)


def family(copies, words=100):
    """Copies of one text with up to four words replaced: pairs on both sides of 0.8."""
    base, found = [f"wort{x}" for x in RNG.integers(0, 10**9, words)], []
    for i in range(copies):
        text = list(base)
        for at in RNG.choice(words, 1 + i % 4, replace=False):
            text[at] = f"neu{i}x{at}"
        found.append(" ".join(text))
    return found


def merged(n, pairs):
    root = list(range(n))
    for i, j in pairs:
        root = [root[i] if r == root[j] else r for r in root]
    return root


@pytest.mark.parametrize("crowd", [2048, 16])
def test_near_classes_are_those_of_all_pairs(spark, monkeypatch, crowd):
    """Families of 60 copies: candidates make kins, and in a kin every pair decides."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "BLOCK_ROWS", crowd)
    texts = [t for _ in range(3) for t in family(60)]
    prints = [simhash.fingerprint(t.encode(), 5, simhash.STAGE_WORDS, repeats=False) for t in texts]
    whole = [[w % (1 << 64) for w in f] for f in prints]
    candidates = []
    for i, j in itertools.combinations(range(len(texts)), 2):
        differ = [x ^ y for x, y in zip(whole[i], whole[j])]
        meet = any((d >> low & (1 << width) - 1).bit_count() <= 1 for d in differ for low, width in simhash.bounds(3))
        if sum(d.bit_count() for d in differ) <= simhash.STAGE_DISTANCE and meet:
            candidates.append((i, j))
    kin = merged(len(texts), candidates)
    root = merged(len(texts), [(i, j) for i, j in itertools.combinations(range(len(texts)), 2)
                               if kin[i] == kin[j] and jaccard(texts[i], texts[j]) >= 0.8])
    kept = simhash.keep_one(spark.createDataFrame(rows_of(list(enumerate(texts))), EXTRA)).collect()
    assert sorted(r.doc_id for r in kept) == sorted({root.index(r) for r in root})


def test_alike_sets_are_connected_by_a_forest():
    for sides in (1, 2):
        for _ in range(30):
            base = RNG.integers(0, 1 << 62, 60)
            sets = [np.unique(np.where(RNG.random(60) < RNG.choice([0.02, 0.1, 0.3]), RNG.integers(0, 1 << 62, 60), base))
                    for _ in range(25)] + [np.zeros(0, np.int64)] * 2
            side = RNG.integers(0, sides, len(sets))
            links = simhash.alike(sets, side, 0.8)

            def close(i, j):
                both = len(np.intersect1d(sets[i], sets[j]))
                return both >= 0.8 * (len(sets[i]) + len(sets[j]) - both)

            pairs = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2)
                     if close(i, j) and (side.min() == side.max() or side[i] != side[j])]
            assert set(links) <= set(pairs)
            root, mine = merged(len(sets), pairs), merged(len(sets), links)
            assert [root.index(r) for r in root] == [mine.index(r) for r in mine]
            assert len(links) < len(sets)
    assert simhash.alike([], np.zeros(0, np.int64), 0.8) == []


EXTRA_NAMES = [c.split()[0] for c in EXTRA.split(", ")]


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)]
    found = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {(r.node, r.root) for r in found} == {(i, 0) for i in range(41)} | {(i, 100) for i in range(100, 140)}


def test_components_of_hubs(spark, monkeypatch):
    """Nodes with more links than HUB are not gathered; classes are the same."""
    monkeypatch.setattr(components, "HUB", 5)
    links = [(7, i) for i in range(8, 60)] + [(60, i) for i in range(61, 90)] + [(3, 59), (89, 2), (200, 201)]
    found = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {(r.node, r.root) for r in found} == {(i, 3) for i in [3, *range(7, 60)]} | {(i, 2) for i in [2, *range(60, 90)]} | {
        (200, 200), (201, 200)}


def roots_of(links):
    """The least node that each node of the links reaches."""
    root = {x: x for link in links for x in link}
    for a, b in links:
        old, new = max(root[a], root[b]), min(root[a], root[b])
        root = {x: new if r == old else r for x, r in root.items()}
    return root


@pytest.mark.parametrize("piece", [4, 1 << 16])
def test_components_of_random_links(spark, monkeypatch, piece):
    """Links that repeat, lead both ways or to their own node; nodes that are words, numbers or texts."""
    monkeypatch.setattr(components, "PIECE", piece)
    drawn = [(int(a), int(b)) for a, b in np.random.default_rng(8).integers(-150, 150, (220, 2))]
    drawn += [(b, a) for a, b in drawn[:30]] + drawn[:30]
    for kind, node in (("long", int), ("string", str), ("array<long>", lambda x: (x, -x))):
        links = [(node(a), node(b)) for a, b in drawn]
        found = components.components(spark.createDataFrame(links, f"a {kind}, b {kind}")).collect()
        got = {(tuple(r.node), tuple(r.root)) if kind[0] == "a" else (r.node, r.root) for r in found}
        want = roots_of([x for x in links if x[0] != x[1]])
        assert got == set(want.items()) and len(found) == len(want)


def test_stars_of_a_task_are_bounded(monkeypatch):
    """A task gives what it holds when it holds more than PIECE links; what is connected stays so."""
    monkeypatch.setattr(components, "PIECE", 10)
    links = [(int(a), int(b)) for a, b in np.random.default_rng(9).integers(0, 400, (300, 2))]
    batches = [pa.RecordBatch.from_arrays([pa.array([x[i] for x in links[at: at + 7]]) for i in (0, 1)], ["a", "b"])
               for at in range(0, len(links), 7)]
    given = list(components.local_stars(iter(batches)))
    assert len(given) > 1 and max(x.num_rows for x in given) <= 10 + 7
    stars = [(r["a"], r["b"]) for x in given for r in x.to_pylist()]
    assert all(a > b for a, b in stars)
    want = roots_of([x for x in links if x[0] != x[1]])
    assert roots_of(stars) == {x: r for x, r in want.items()}


def test_components_take_few_tasks(spark):
    """The driver keeps a record of every task: a path of 400 nodes takes a few stages of all partitions."""
    context, held = spark.sparkContext, {k: spark.conf.get(k) for k in (
        "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    links = spark.createDataFrame([(i, i + 1) for i in range(400)], "a long, b long").repartition(40).cache()
    links.count()
    for k, v in zip(held, ("40", "false")):
        spark.conf.set(k, v)
    try:
        context.setJobGroup("few tasks", "")
        found = components.components(links).collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in held.items():
            spark.conf.set(k, v)
        links.unpersist()
    assert {(r.node, r.root) for r in found} == {(i, 0) for i in range(401)}
    tracker = context.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup("few tasks") for s in tracker.getJobInfo(job).stageIds}
    tasks = sum(x.numCompletedTasks for x in map(tracker.getStageInfo, stages) if x)
    assert 0 < tasks < 40 * 30, tasks


def test_mixing_draws_within_budget(documents, texts, empty):
    plan = {r.source: r for r in mixing.plan_mix(documents).collect()}
    drawn = mixing.mix(documents).collect()
    tokens = {s: sum(r.tokens for r in drawn if r.source == s) for s in plan}
    largest = max(plan.values(), key=lambda r: r.tokens)
    assert largest.passes == 1 and largest.rest == 0
    for s, r in plan.items():
        assert r.passes * r.tokens <= tokens[s] <= r.budget <= 2.0001 * r.tokens
    counts = defaultdict(int)
    for r in drawn:
        counts[r.doc_id] += 1
    assert set(counts) == {i for i, _ in texts} and max(r.epoch for r in drawn) <= 1
    assert mixing.mix(empty).count() == 0


def test_mixing_meets_entropy_and_budget(spark):
    rows = [(i, "ba " * (60 if i % 10 < 7 else 10), "en", None if i % 10 == 9 else f"s{i % 10 // 4}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    total = sum(len(t.split()) for _, t, *_ in rows)
    plan = mixing.plan_mix(docs, repetition_limit=None, entropy=1.2, budget=total).collect()
    weights = [r.weight for r in plan]
    assert math.isclose(sum(weights), 1) and -sum(w * math.log(w) for w in weights) >= 1.2
    a = plan[0].exponent + 1 / mixing.GRID
    shares = [r.tokens / total for r in plan]
    z = sum(p**a for p in shares)
    assert -sum(p**a / z * math.log(p**a / z) for p in shares) < 1.2
    drawn = mixing.draw(docs, mixing.cut(mixing.plan_mix(docs, repetition_limit=None, entropy=1.2, budget=total)))
    assert abs(sum(len(r.text.split()) for r in drawn.collect()) - total) <= 60 * 4


def test_mixing_adds_up_a_slot_before_the_window(spark):
    """Rows of one id are one row of the running sums; the cutoff stays that of the rows."""
    rows = [("s", 4, 2, i // 300 and f"{i:04x}" or "0000", "0000" if i < 300 else f"{i:04x}"[:4]) for i in range(310)]
    keyed = spark.createDataFrame(rows, "source string, rest long, tokens long, slot string, block string")
    ends = spark.createDataFrame([("s", "0000", 700)], "source string, block string, left long")
    assert [(r.slot, r.tokens, r.upto) for r in mixing.summed_slots(keyed, ends).collect()] == [("0000", 600, 600)]
    docs = [(None, "a b", "en", "s", 3, "h", 1, "x", 2, 3)] * 300 + rows_of([(i, "a b c") for i in range(50)])
    drawn = mixing.mix(spark.createDataFrame(docs, EXTRA), budget=900, repetition_limit=None, entropy=0.0).collect()
    assert sum(r.tokens for r in drawn) <= 900 and sum(r.doc_id is None for r in drawn) % 300 == 0


def test_url_filter_is_exact(spark):
    hosts = [f"h{i}.example.net" for i in range(3000)]
    rows = [(i, f"https://{h.upper()}/a?b#c", "x", "y", "z") for i, h in enumerate(hosts)]
    rows += [(9000, None, "x", "y", "z"), (9001, "nothing", "x", "y", "z"), (9002, "a://", "x", "y", "z"),
             (9003, "http://sub.example.org/es/1", "x", "y", "z"), (9004, "http://EXAMPLE.org?x=/es/", "x", "y", "z"),
             (9005, "http://a.com/fr/://b", "x", "y", "z"), (0, rows[0][1], "x", "y", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string, verdict string")
    listed = spark.createDataFrame([(h,) for h in hosts[::7]] + [("absent.example",)], "key string")
    for max_bits in (url_filter.MAX_BITS, 64):  # the cascade, and the join beyond its bound
        got = {r.page_id: r for r in url_filter.filter_urls(pages, listed=listed, max_bits=max_bits).collect()}
        assert all(got[i].verdict == ("block" if i % 7 == 0 else "allow") for i in range(3000))
        assert all(got[i].host == "" == got[i].path and got[i].verdict == "allow" for i in (9000, 9001, 9002))
        assert (got[9003].rule, got[9003].verdict) == ("example.org/es/", "block")
        assert (got[9004].path, got[9004].rule) == ("", None) and got[9005].rule == "com/fr/"
    assert len(url_filter.build_cascade(url_filter.cut(pages.select(
        url_filter.host_of(pages.url).alias("key")).distinct().selectExpr(
        "key", "hash(key) % 7 = 0 AS listed")))) >= 2
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def expected_removal(texts):
    first = {}
    for i, t in sorted([x for x in texts if x[0] is not None], key=lambda x: x[0]):
        data = (t or "").encode()
        for k in range(len(data) - 49):
            first.setdefault(data[k:k + 50], i)
    out = []
    for i, t in texts:
        data = (t or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for k in range(len(data) - 49):
            if i is not None and first[data[k:k + 50]] < i:
                gone[k:k + 50] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((i, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("records, chunk, piece", [(1_500_000, 4 << 20, 1 << 20), (300, 3000, 90)])
def test_suffix_dedup_matches_brute_force(documents, texts, empty, monkeypatch, records, chunk, piece):
    monkeypatch.setattr(suffix_dedup, "RECORDS_PER_BUCKET", records)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    got = [tuple(r) for r in suffix_dedup.dedup_report(documents).collect()]
    assert sorted(got, key=repr) == sorted(expected_removal(texts), key=repr)
    assert suffix_dedup.dedup_report(empty).count() == 0


def test_suffix_dedup_returns_what_is_kept(spark):
    shared = "".join(map(chr, RNG.integers(97, 123, 80)))
    rows = rows_of([(1, "one " + shared), (2, shared + " two"), (3, "x" * 49)])
    out = {r.doc_id: r for r in suffix_dedup.dedup_spans(spark.createDataFrame(rows, EXTRA), with_text=True).collect()}
    assert bytes(out[2].kept) == b" two" and [(s.start, s.end) for s in out[2].spans] == [(0, 80)]
    assert bytes(out[1].kept) == ("one " + shared).encode() and bytes(out[3].kept) == b"x" * 49


def test_bound_of_the_sample_is_a_parameter(spark):
    """Longer texts are not learned from, but scored whole."""
    rows = [(i, "guten morgen welt " * 4 if i % 2 else "good morning world " * 4, "de" if i % 2 else "en") for i in range(40)]
    table = spark.createDataFrame([*rows, (99, "bonjour le monde " * 90, "fr")], "doc_id long, text string, lang string")
    assert language.model_from(table, most_chars=500).languages == ["de", "en"]
    assert language.model_from(table).languages == ["de", "en", "fr"]
    bad = spark.createDataFrame(
        [(i, ("Vile filth. " if i % 2 else "Nice day. ") * (300 if i > 280 else 3)) for i in range(300)], "doc_id long, text string")
    labels = bad.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    scored = toxicity.find_toxic(bad, labels, most_chars=60).collect()
    assert len(scored) == 300 and all((r.predicted == 1) == (r.doc_id % 2 == 1) for r in scored)


@pytest.mark.parametrize("records", [1_500_000, 7])
def test_suffix_dedup_cuts_every_place_of_a_phrase_in_its_first_document(spark, monkeypatch, records):
    """A phrase that is repeated in part goes in part wherever it stands: twice in one text, in
    rows that share a doc_id, and under the least doc_id there is."""
    monkeypatch.setattr(suffix_dedup, "RECORDS_PER_BUCKET", records)
    letters = lambda n: "".join(map(chr, RNG.integers(97, 123, n)))
    least, out = -(1 << 63), []
    for i in range(20):
        shared, around = letters(70), letters(40)
        block = around + shared + around
        out += [(least if i == 0 else i, letters(50) + shared + letters(30)), (100 + i, block + letters(60) + block),
                (200 + i, letters(9) + shared[:60] + block), (200 + i, block + letters(20))]
    found = suffix_dedup.dedup_report(spark.createDataFrame(rows_of(out), EXTRA))
    assert sorted([tuple(r) for r in found.collect()], key=repr) == sorted(expected_removal(out), key=repr)
