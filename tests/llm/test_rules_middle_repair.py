"""Host rules, fill-in-the-middle and conversation repair against brute force, and on nulls,
empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import heapq
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from hemicycle.llm import conversation_repair as repair
from hemicycle.llm import fill_in_middle as middle
from hemicycle.llm import host_rules, queries

RNG = np.random.default_rng(11)
DOCS = "doc_id long, text string, source string, host string, n_words long, kept string, words int, __row string, rank int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def doc(i, text, source="a"):
    return (i, text, source, "x", 9, "no", 1, "r", 2)


def words(n):
    return [f"w{RNG.integers(1 << 30)}é"[: int(RNG.integers(3, 11))] for _ in range(n)]


ODD_TEXTS = [
    None, "", " \t\n", "one", "a b c d e a b c d e f", "x y " * 400, "same line\nsame line\n\n\nsame line \n" * 9,
    "# * $ % & | < >" * 3, " nbsp wide \x0b\x0c\r end \n", "tail   ", "  lead", "p<S>q r", "<P>", "é" * 300 + " ü",
    "🙂 " * 50 + "🙂", "long " * 30_000 + "end", " ".join(words(2000)), "\n".join(" ".join(words(7)) for _ in range(40)),
]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [doc(i, t, None if i % 5 == 4 else "ab"[i % 2]) for i, t in enumerate(ODD_TEXTS)]
    rows += [doc(100 + i, " ".join(words(int(RNG.integers(8, 60)))), f"h{i % 4}") for i in range(120)]
    rows += [doc(500 + i, "spam " * 30, "bad") for i in range(40)]  # a host that fails nearly always
    rows += [doc(700, " ".join(words(40)), "bad"), doc(701, "few words", "tiny"), doc(702, None, "tiny")]
    rows += [doc(700, rows[3][1], "h1"), doc(None, "no id " + " ".join(words(20)), "h2"), rows[5]]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


# ---------------------------------------------------------------- rules


def measured(text):
    found = WORD.findall(text or "")
    windows = Counter(tuple(found[i:i + 5]) for i in range(len(found) - 4))
    hit = {i + k for i in range(len(found) - 4) if windows[tuple(found[i:i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit))


def base_fails(n, n_repeat):
    return n < 10 or 100 * n_repeat > 20 * n


def prior(n, k):
    """Mean and weight of the beta prior by moments, written out."""
    mean, w = k.sum() / n.sum(), n / n.sum()
    spread, even = (w * (k / n - mean) ** 2).sum(), mean * (1 - mean)
    if even == 0:
        return mean, 1e6
    alike = (spread - even * (w * (1 - w) / n).sum()) / even / ((w * (1 - w)).sum() - (w * (1 - w) / n).sum())
    return mean, (min(max(1 / alike - 1, 1), 1e6) if alike > 0 else 1e6)


def rejected_by(rows):
    """Host: first rule whose shrunk rate is over one half."""
    fails = defaultdict(list)
    for r in rows:
        if r.source is not None:
            n, chars, signs, dup, again = measured(r.text)
            lines = [x for x in (r.text or "").split("\n") if WORD.search(x)]
            fails[r.source].append((n < 10, 100 * again > 20 * n, not 3 * n <= chars <= 12 * n, 10 * signs > n,
                                    10 * dup > 3 * len(lines)))
    hosts = sorted(fails)
    n = np.array([len(fails[h]) for h in hosts], float)
    out = {}
    for j, rule in enumerate(host_rules.RULES):
        k = np.array([sum(f[j] for f in fails[h]) for h in hosts], float)
        mean, weight = prior(n, k)
        for h, rate in zip(hosts, (k + mean * weight) / (n + weight)):
            if rate > 0.5:
                out.setdefault(h, rule)
    return out


def test_rules_match_brute_force(documents):
    rows = documents.collect()
    rejected = rejected_by(rows)
    assert rejected["bad"] == "repetition" and "h1" not in rejected
    got, want = defaultdict(list), defaultdict(list)
    for r in host_rules.judge(documents).collect():
        got[r.doc_id].append(repr(tuple(r)[1:]))
    for r in rows:
        m = measured(r.text)
        failed, host_rule = base_fails(m[0], m[4]), rejected.get(r.source)
        want[r.doc_id].append(repr((*m, failed, not failed and host_rule is None, host_rule)))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_rates_are_shrunk_towards_all_rows(spark):
    """A small host that only fails is spared; a large one is not; the prior is by moments."""
    good = " ".join(words(30))
    rows = [doc(i, good if i % 10 else "short", f"h{i % 20}") for i in range(2000)]
    rows += [doc(5000 + i, "short", "large") for i in range(200)] + [doc(6000, "short", "small")]
    rows += [doc(7000, good, "large"), doc(7001, good, "small")]
    docs = spark.createDataFrame(rows, DOCS)
    hosts = host_rules.failures(host_rules.measure(docs))
    n, k = np.array([(r.n, r.few_words) for r in hosts.collect()], float).T
    got = host_rules.beta_prior(hosts)["few_words"]
    assert got == pytest.approx(prior(n, k), rel=1e-6)
    kept = {r.doc_id: r.kept for r in host_rules.judge(docs).collect()}
    assert not kept[7000] and kept[7001] and kept[1]
    whole = host_rules.keep_good(docs)
    assert whole.columns == docs.columns
    assert sorted(r.doc_id for r in whole.collect()) == sorted(i for i, x in kept.items() if x)


def test_rules_on_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert host_rules.judge(empty).count() == 0 == host_rules.keep_good(empty).count()
    assert host_rules.judge(spark.createDataFrame([doc(1, None, None)], DOCS)).first()[1:] == (0, 0, 0, 0, 0, True, False, None)


def test_rules_are_native(spark):
    plan = host_rules.measure(spark.createDataFrame([doc(1, "a")], DOCS))._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan and "Exchange" not in plan


# ---------------------------------------------------------------- fill in the middle

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def expected_middle(i, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    d = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(d[8 * k: 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(tokens), "plain", None, None, text
    x, y = sorted(v % (len(tokens) + 1) for v in h[:2])
    a, b, c = "".join(tokens[:x]), "".join(tokens[x:y]), "".join(tokens[y:])
    if h[3] % 100 < 80:
        return len(tokens), "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return len(tokens), "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def test_middle_matches_brute_force_and_restores(spark, documents):
    texts = [(1000 + 40 * k + j, t) for k, t in enumerate(ODD_TEXTS) for j in range(12)]
    docs = documents.unionByName(spark.createDataFrame([doc(i, t) for i, t in texts], DOCS))
    done = middle.transform(docs)
    got = sorted((repr(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in done.collect())
    want = sorted((repr(r.doc_id), *expected_middle(r.doc_id, r.text)) for r in docs.select("doc_id", "text").collect())
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert {w[2] for w in want} == {"plain", "spm", "psm"}
    back = done.select("doc_id", middle.restore(done["output"], done["form"]).alias("text"))
    assert sorted(map(repr, back.collect())) == sorted(
        repr(r) for r in docs.selectExpr("doc_id", "coalesce(text, '') text").collect())
    assert middle.digests(docs.limit(0)).count() == 0


@pytest.mark.parametrize("error", [0, 1, 5, 120])
def test_rank_index_is_exact_and_error_bounded(error):
    for steps in ([], [1], RNG.integers(1, 15, 5000), [3] * 9000, [1] * 300 + [500] * 300 + [2] * 300, [100_000, 1, 1, 90_000]):
        offsets = np.concatenate([[0], np.cumsum(steps)]).astype(np.int64)
        index = middle.fit(offsets, error)
        assert [index.offset(k) for k in range(len(offsets))] == offsets.tolist()
        assert np.abs(index.residual.astype(int)).max() <= error + 1
    assert len(middle.fit(np.arange(0, 50_000, 6), 0).first) == 1  # even words are one line


def test_middle_does_not_shuffle(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert "Exchange" not in middle.digests(docs)._jdf.queryExecution().executedPlan().toString()


# ---------------------------------------------------------------- conversations

TALKS = "conv_id long, turn long, role string, text string, pos int, head string, gone boolean, audit string, part int"


def damaged_rows(rows):
    out = []
    for c, turn, role, text in rows:
        role, text = (" " if role is None else role), (" " if text is None else text)
        key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [(c, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def cheapest(rows):
    """(cost, audit, repaired) by search over partial audits in order of cost, then of ASCII."""
    faults, seen = [], set()
    for role, text in rows:
        kind = ("blank" if not WORD.search(text) else "duplicate" if (role, text) in seen
                else "truncated" if text.rstrip(" \t\n\x0b\x0c\r")[-1] not in ".!?" else None)
        seen.add((role, text))
        faults.append(kind)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, shape, out = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", shape):
            return cost, audit, out, Counter(faults)
        if (i, shape[-2:], audit) in done:
            continue
        done.add((i, shape[-2:], audit))
        lawful = lambda x: re.fullmatch("s?(ua)*u?", shape + x)
        for name in ("user", "assistant"):
            if lawful(name[0]):
                heapq.heappush(heap, (cost + 2, audit + "I", i, shape + name[0], out + ((name, ""),)))
        if i == len(rows):
            continue
        heapq.heappush(heap, (cost + 3, audit + "D", i + 1, shape, out))
        if faults[i] in ("blank", "duplicate"):
            continue
        late, (role, text) = int(faults[i] == "truncated"), rows[i]
        if role[:1] in ("s", "u", "a") and lawful(role[0]):
            heapq.heappush(heap, (cost + late, audit + "K", i + 1, shape + role[0], out + (rows[i],)))
        for name in ("user", "assistant"):
            if lawful(name[0]):
                heapq.heappush(heap, (cost + 2 + late, audit + "R", i + 1, shape + name[0], out + ((name, text),)))


def expected_repairs(rows):
    groups = defaultdict(list)
    for r in damaged_rows(rows):
        groups[r[0]].append(r)
    out = []
    for c in {r[0] for r in rows}:
        talk = sorted(groups[c], key=lambda r: (r[1] is not None, r[1] or 0, r[2][:64], r[3][:64]))
        turns = [r[1] for r in talk if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, repaired, faults = cheapest([r[2:] for r in talk])
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(talk, talk[1:]))
        digest = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in repaired).encode()).hexdigest()
        out.append((c, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest))
    return sorted(out, key=repr)


def talks(spark, rows):
    return spark.createDataFrame([(*r, 1, "h", True, "a", 2) for r in rows], TALKS).repartition(5)


def test_repair_matches_brute_force(spark):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "unknown"]
    texts = ["Hello.", "Yes!", "cut off", "", " \n", None, "Why? ", "Same.", "x" * 3]
    rows = []
    for c in range(400):
        n = int(RNG.integers(1, 8))
        for t in range(n):
            turn = None if RNG.random() < 0.05 else t * (1 + c % 3)
            rows.append((c if c != 7 else None, turn, roles[RNG.integers(len(roles) if c % 2 else 3)], texts[RNG.integers(len(texts))]))
    rows += rows[20:30]  # repeated rows
    rows += [(900, t, None, "x") for t in range(3)] + [(901, None, "user", None), (901, None, "user", None)]
    got = sorted(map(tuple, repair.repair(talks(spark, rows)).collect()), key=repr)
    assert got == expected_repairs(rows)


def test_repair_of_the_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text")
    got = queries.QUERIES["op13_conversation_repair"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got), key=repr) == expected_repairs([tuple(r) for r in table.collect()])


def test_repaired_rows_are_lawful_and_hash_alike(spark):
    rows = [(c, t, ["user", "system", "assistant"][int(RNG.integers(3))], f"text {RNG.integers(5)}.") for c in range(30) for t in range(12)]
    table = talks(spark, rows)
    hashes = {r.conv_id: r.repaired_sha256 for r in repair.repair(table).collect()}
    built = defaultdict(list)
    for r in sorted(repair.repair(table, rows=True).collect()):
        assert r.place == len(built[r.conv_id])
        built[r.conv_id].append(r)
    for c in range(30):
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in built[c]))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in built[c]).encode()).hexdigest() == hashes[c]
    plain = repair.repair(talks(spark, [(1, 0, "user", "a."), (1, 1, "assistant", "b!")]), damaged=False).first()
    assert plain.cost == 0 and plain.audit == "KK"


def test_conversations_without_rows_and_empty_tables(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = repair.repair(talks(spark, [(gone, 0, "user", "a.")])).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.repair(talks(spark, [])).count() == 0


@pytest.mark.parametrize("chunk", [1, 3, 64])
def test_audits_do_not_depend_on_blocks(chunk):
    codes = [bytes(RNG.integers(0, 10, int(n)).astype(np.uint8) + repair.FIRST_CODE) for n in RNG.integers(0, 40, 60)]
    assert repair.audits(codes, chunk) == repair.audits(codes)


def test_a_long_conversation_is_searched_in_blocks(spark):
    """Over two blocks of rows in one conversation, over several partitions."""
    n = 2 * repair.CHUNK + 100
    rows = [(5, t, "user" if t % 2 == 0 else "assistant", f"row {t}.") for t in range(n)]
    got = repair.repair(talks(spark, rows), damaged=False).first()
    assert got.audit == "K" * n and got.cost == got.gaps == got.illegal == 0
    whole = "\n".join(f"{r[2]}:{r[3]}" for r in rows)
    assert got.repaired_sha256 == hashlib.sha256(whole.encode()).hexdigest()
