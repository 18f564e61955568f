"""Repair of damaged conversations: the cheapest edits, and of those the least in name.

Rows of a conversation stand in order of turn (nulls first), then of role and of the text's
first ``TIE_CHARS`` characters, then of a hash of the text; only equal rows are left, which are
alike in any order. The first fault of a row counts: blank, duplicate (role and text were
there before), truncated. Edits: Keep (0), Rerole to the next role (2), Delete (3, the only
one for blank and duplicate rows), Insert an empty row (2, anywhere); a truncated row that
stays adds 1. The roles left must read ``(s?(ua)+)?`` by their initials.

*Search.* Nodes are (rows used, last role given out); a backward pass gives every node its
cost to the end. Arcs on cheapest ways are kept. From a node every edit leads along one arc,
so the arc of the least letter is a node's own, and nodes are ranked by the audit (the letters
on the way) they begin: first by one letter, then, with the rank of the node that the doubled
pointer reaches, by 2, 4, 8 letters. Arcs are chosen by letter and then by the rank they lead
to, and the audit is unrolled through doubled pointers: its first 2L steps are its first L
steps and what the L-step pointer makes of them. An end mark, least of all letters, lets a
shorter audit come before its own continuations.

*Size.* Rows are range-partitioned in their order, so a conversation with a third of all rows
lies over many tasks; equal rows share a partition only by chance, as a row number parts them.
Of each row one letter (role, fault) is gathered, in strings of at most ``CHUNK`` rows first,
then one string a conversation, no longer than the audit that has to be returned. The search
walks such a string in blocks of ``CHUNK`` rows, back for costs and forth for the audit, with
memory for the blocks at hand. Texts meet their audit as a stream sorted by conversation and
place; no conversation's texts are held, but its SHA-256 needs them in one stream.

Defined cases: nulls in role and text are one blank, in the seed likewise; a null conv_id is a
conversation; null turns come first and enter no gap; repeated rows are rows (and duplicates);
roles are kept as they are, only their first character decides; a conversation without rows
after damage has zeros, an empty audit and the hash of the empty string; an empty table gives
no rows; only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemicycle.llm.common import cut, wanted

CHUNK_BITS, TIE_CHARS = 12, 64
CHUNK = 1 << CHUNK_BITS
#: Nodes that are searched at a time, over conversations of like length.
BUNDLE = 1 << 16
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
FAR = 1 << 40
#: Letters of edits in ASCII order after the end mark.
LETTERS = np.frombuffer(b"\0DIKR", np.uint8)
END, D, I, K, R = range(5)
#: What was given out last; rows of a code are of class (system, user, assistant, other).
START, S, U, A = range(4)
FOLLOWS = np.array([U, U, A, U])
KEEPS = {0: [(START, S)], 1: [(START, U), (S, U), (A, U)], 2: [(U, A)], 3: []}
#: Codes of rows: class, + 4 if truncated; blank; duplicate; then the end, and filling after it.
BLANK, DUPLICATE, LAST, FILL = 8, 9, 10, 11
FIRST_CODE = ord("a")
SPACES = " \t\n\x0b\x0c\r"


def code_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code: cost and target of Keep (12 x 4), and cost of Rerole (12)."""
    cost, target, rerole = np.full((12, 4), FAR), np.zeros((12, 4), np.int64), np.full(12, FAR)
    for code in range(8):
        late = TRUNCATED if code >= 4 else 0
        rerole[code] = REROLE + late
        for state, then in KEEPS[code % 4]:
            cost[code, state], target[code, state] = late, then
    cost[LAST, [START, A]], target[LAST] = 0, np.arange(4)  # the end mark closes a lawful sequence
    cost[FILL], target[FILL] = 0, np.arange(4)
    return cost, target, rerole


KEEP_COST, KEEP_TO, REROLE_COST = code_tables()
DELETE_COST = np.where(np.arange(12) < LAST, DELETE, FAR)


def costs_to_end(codes: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Cheapest way from each node: (rows, places + 1, 4), given that of the last places."""
    rows, places = codes.shape
    cost = np.empty((rows, places + 1, 4), np.int64)
    cost[:, places] = after
    for j in range(places - 1, -1, -1):
        code, ahead = codes[:, j], cost[:, j + 1]
        kept = KEEP_COST[code] + np.take_along_axis(ahead, KEEP_TO[code], 1)
        best = np.minimum(np.minimum(kept, DELETE_COST[code][:, None] + ahead),
                          REROLE_COST[code][:, None] + ahead[:, FOLLOWS])
        inside = codes[:, j] != FILL
        for _ in range(2):  # at most two inserts pay in a row
            best = np.where(inside[:, None], np.minimum(best, INSERT + best[:, FOLLOWS]), best)
        cost[:, j] = np.minimum(best, FAR)
    return cost


def least_audits(codes: np.ndarray, cost: np.ndarray, entry: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Least cheapest audits from the entry states of the rows of ``codes``, and where they end."""
    rows, places = codes.shape
    width = (places + 1) * 4
    n = rows * width
    here = np.arange(n).reshape(rows, places + 1, 4)
    inner, ahead = cost[:, :-1], here[:, 1:]
    keep_to = np.take_along_axis(ahead, KEEP_TO[codes], 2)
    closing = (codes >= LAST)[:, :, None]
    # per node the arcs of (end or keep), delete, insert, rerole: letter, cost, end
    arcs = [
        (np.where(closing, END, K), KEEP_COST[codes], keep_to),
        (np.full_like(closing, D, dtype=np.int64), np.broadcast_to(DELETE_COST[codes][:, :, None], inner.shape), ahead),
        (np.full_like(closing, I, dtype=np.int64), np.where(codes[:, :, None] == FILL, FAR, np.full(inner.shape, INSERT)),
         here[:, :-1][:, :, FOLLOWS]),
        (np.full_like(closing, R, dtype=np.int64), np.broadcast_to(REROLE_COST[codes][:, :, None], inner.shape),
         ahead[:, :, FOLLOWS]),
    ]
    flat = cost.reshape(-1)
    optimal = [(np.where(paid + flat[to] == inner, np.broadcast_to(letter, inner.shape), 9), to) for letter, paid, to in arcs]

    def chosen(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Letter and end of each node's least optimal arc, by letter and rank of its end."""
        letter, end = np.zeros(n, np.int64), np.arange(n)
        keys = np.stack([letters * (n + 1) + rank[to] for letters, to in optimal])
        which = keys.argmin(0)[None]
        nodes = here[:, :-1].reshape(-1)
        best = np.take_along_axis(np.stack([x for x, _ in optimal]), which, 0)[0].reshape(-1)
        known = best < 9
        letter[nodes] = np.where(known, best, 0)
        end[nodes] = np.where(known, np.take_along_axis(np.stack([x for _, x in optimal]), which, 0)[0].reshape(-1), nodes)
        return letter, end

    letter, pointer = chosen(np.zeros(n, np.int64))
    rank = letter
    while True:  # ranks of nodes by audits of 1, 2, 4, ... letters
        _, longer = np.unique(rank * (n + 1) + rank[pointer], return_inverse=True)
        still = (pointer == pointer[pointer]).all()
        rank, pointer = longer, pointer[pointer]
        if still:
            break
    letter, pointer = chosen(rank)
    steps = (np.arange(rows) * width + entry)[:, None]
    while (pointer[steps[:, -1]] != steps[:, -1]).any():  # unroll through doubled pointers
        steps = np.concatenate([steps, pointer[steps]], axis=1)
        pointer = pointer[pointer]
    # steps on the last node of a row and end marks have letter 0, which is no edit
    marks = LETTERS[letter[steps]]
    final = steps[:, -1] - np.arange(rows) * width
    return [row[row != 0].tobytes() for row in marks], final % 4


def bundles(lengths: list[int]) -> Iterator[list[int]]:
    """Numbers of conversations of like length, few enough to be searched together."""
    bundle: list[int] = []
    for i in sorted(range(len(lengths)), key=lengths.__getitem__):
        if bundle and (len(bundle) + 1) * 4 * (min(lengths[i], CHUNK) + 1) > BUNDLE:
            yield bundle
            bundle = []
        bundle.append(i)
    if bundle:
        yield bundle


def audits(sequences: list[bytes], chunk: int = CHUNK) -> list[tuple[int, bytes]]:
    """Cost and audit of each sequence of codes (bytes from FIRST_CODE on), block by block."""
    found: list[tuple[int, bytes]] = [(0, b"")] * len(sequences)
    lengths = [len(s) + 1 for s in sequences]
    for bundle in bundles(lengths):
        longest = max(lengths[i] for i in bundle)
        blocks = -(-longest // chunk)

        def block(b: int) -> np.ndarray:
            out = np.full((len(bundle), min(chunk, longest - b * chunk)), FILL, np.int64)
            for row, i in enumerate(bundle):
                part = np.frombuffer(sequences[i], np.uint8)[b * chunk: (b + 1) * chunk]
                out[row, :len(part)] = part.astype(np.int64) - FIRST_CODE
                if 0 <= len(sequences[i]) - b * chunk < out.shape[1]:
                    out[row, len(sequences[i]) - b * chunk] = LAST
            return out

        after = [np.zeros((len(bundle), 4), np.int64)]  # costs at the ends of blocks, last first
        for b in range(blocks - 1, 0, -1):
            after.append(costs_to_end(block(b), after[-1])[:, 0])
        state, parts = np.zeros(len(bundle), np.int64), [[] for _ in bundle]
        for b in range(blocks):
            codes = block(b)
            cost = costs_to_end(codes, after.pop())
            if b == 0:
                total = cost[:, 0, START]
            texts, state = least_audits(codes, cost, state)
            for kept, text in zip(parts, texts):
                kept.append(text)
        for row, i in enumerate(bundle):
            found[i] = (int(total[row]), b"".join(parts[row]))
    return found


def crc_of(key: Column, turn: Column) -> Column:
    return F.crc32(F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit(" ")) for c in (key, turn)]))


def whole(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) without nulls in role and text; no row is ``gone``."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return conversations.select("conv_id", "turn", *said, F.lit(False).alias("gone"))


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) to the damaged rows; a dropped row stays as ``gone``."""
    rows = whole(conversations)
    kind = crc_of(F.col("conv_id"), F.col("turn")) % 20
    text = (F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 0, "").otherwise(text).alias("text"), (kind == 0).alias("gone"),
        F.explode(F.array_repeat(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("__copy"),
    ).drop("__copy")


def in_order(rows: DataFrame) -> DataFrame:
    """Rows with ``pos``, a number that grows along (conv_id, order in the conversation)."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.substring("role", 1, TIE_CHARS),
             F.substring("text", 1, TIE_CHARS), F.xxhash64("role", "text"), F.xxhash64("role", F.lit("|"), "text")]
    dealt = rows.withColumn("__deal", F.monotonically_increasing_id()).repartitionByRange(*order, "__deal")
    return cut(dealt.sortWithinPartitions(*order).select(
        "conv_id", "turn", "role", "text", "gone", F.monotonically_increasing_id().alias("pos")))


def row_codes(ordered: DataFrame) -> DataFrame:
    """(conv_id, pos, code): one letter for each row that is there."""
    last = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    kind = F.coalesce(F.instr(F.lit("sua"), F.substring("role", 1, 1)) - 1, F.lit(-1))
    kind = F.when((F.col("role") == "") | (kind < 0), 3).otherwise(kind)
    light = ordered.where("NOT gone").select(
        "conv_id", "pos", (last == "").alias("blank"), (kind + F.when(last.isin(".", "!", "?"), 0).otherwise(4)).alias("code"),
        F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit("|"), "text", "role").alias("b"))
    light = light.withColumn("code", F.when(F.col("blank"), BLANK).otherwise(F.col("code")))
    firsts = (light.where("NOT blank").groupBy(F.col("conv_id").alias("__c"), F.col("a").alias("__a"), F.col("b").alias("__b"))
              .agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1"))
    found = light.join(
        firsts, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("a") == F.col("__a")) & (F.col("b") == F.col("__b")), "left")
    return found.select("conv_id", "pos", F.char(F.lit(FIRST_CODE) + F.when(
        ~F.col("blank") & (F.col("pos") > F.col("first")), DUPLICATE).otherwise(F.col("code"))).alias("code"))


def joined_codes(strings: DataFrame, part: Column) -> DataFrame:
    """Strings of codes in order, joined per conversation and part of it."""
    gathered = F.sort_array(F.collect_list(F.struct("pos", "codes")))
    return strings.groupBy("conv_id", part.alias("part")).agg(F.min("pos").alias("pos"), gathered.alias("g")).select(
        "conv_id", "pos", F.array_join(F.transform("g", lambda x: x["codes"]), "").alias("codes"))


def audited(codes: DataFrame) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, cost, audit) of conversations that have rows."""
    rows = codes.select("conv_id", "pos", F.col("code").alias("codes"))
    whole = joined_codes(joined_codes(rows, F.shiftright("pos", CHUNK_BITS)), F.lit(0))

    @F.arrow_udf("cost long, audit string")
    def search(strings: pa.Array) -> pa.Array:
        found = audits([x.as_py().encode() for x in strings])
        return pa.StructArray.from_arrays(
            [pa.array([c for c, _ in found], pa.int64()), pa.array([a.decode() for _, a in found], pa.string())],
            ["cost", "audit"])

    def number(codes_of: list[int]) -> Column:
        letters = "".join(chr(FIRST_CODE + c) for c in codes_of)
        return (F.length("codes") - F.length(F.translate("codes", letters, ""))).cast("long")

    rows = whole.select("conv_id", "codes", search("codes").alias("found"))
    return rows.select("conv_id", number([BLANK]).alias("blank"), number([DUPLICATE]).alias("duplicate"),
                       number([4, 5, 6, 7]).alias("truncated"), "found.cost", "found.audit")


RESULT = [*[f"{c} long" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
          "audit string", "repaired_sha256 string"]


class Conversation:
    """What is known of one conversation while its rows stream by, in order."""

    def __init__(self, key, head: dict | None):
        self.key = key
        self.head = head or {"blank": 0, "duplicate": 0, "truncated": 0, "cost": 0, "audit": ""}
        self.audit, self.at, self.state, self.places = self.head["audit"], 0, START, 0
        self.turns, self.least, self.most = 0, None, None
        self.illegal, self.before = 0, None
        self.digest = hashlib.sha256()
        self.given: list[tuple] = []

    def give(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.places else ''}{role}:{text}".encode())
        self.given.append((self.key, self.places, role, text))
        self.places += 1

    def next_role(self) -> str:
        self.state = int(FOLLOWS[self.state])
        return "user" if self.state == U else "assistant"

    def inserts(self) -> None:
        while self.audit[self.at: self.at + 1] == "I":
            self.at += 1
            self.give(self.next_role(), "")

    def row(self, turn: int | None, role: str, text: str) -> None:
        """Take the next row and do the edits up to its own."""
        if turn is not None and turn != self.most:
            self.turns += 1
            self.least, self.most = turn if self.least is None else self.least, turn
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self.give(self.next_role(), text)
        elif edit == "K":
            self.state = {"s": S, "u": U, "a": A}[initial]
            self.give(role, text)

    def result(self) -> tuple:
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        faults = [self.head[c] for c in ("blank", "duplicate", "truncated")]
        return (self.key, gaps, *faults, self.illegal, self.head["cost"], self.audit, self.digest.hexdigest())


def repair(conversations: DataFrame, damaged: bool = True, rows: bool = False, id_column: str = "conv_id",
           turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """One row a conversation: its faults, cost, audit and the hash of the repaired rows.

    With ``rows`` the repaired rows instead: (conv_id, place, role, text). With ``damaged``
    false the given rows are repaired as they are.
    """
    given = wanted(conversations, conv_id=id_column, turn=turn_column, role=role_column, text=text_column)
    given = given.withColumn("turn", F.col("turn").cast("long"))
    ordered = in_order(damage(given) if damaged else whole(given))
    heads = audited(row_codes(ordered)).select(
        "conv_id", F.lit(-1).cast("long").alias("pos"),
        F.struct("blank", "duplicate", "truncated", "cost", "audit").alias("head"))
    stream = ordered.select("conv_id", "pos", "turn", "role", "text", "gone").unionByName(heads, allowMissingColumns=True)
    fields = [f"conv_id {stream.schema['conv_id'].dataType.simpleString()}"]
    fields += ["place long", "role string", "text string"] if rows else RESULT
    names = [f.split()[0] for f in fields]
    kinds = [None, pa.int64(), pa.string(), pa.string()] if rows else [None, *[pa.int64()] * 6, pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done, key_type = None, [], None

        def finish() -> None:
            now.inserts()
            done.extend(now.given if rows else [now.result()])

        def packed() -> pa.RecordBatch:
            columns = zip(*done)
            return pa.RecordBatch.from_arrays([pa.array(c, k or key_type) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            key_type = batch.column(0).type
            for key, pos, turn, role, text, gone, told in zip(*[c.to_pylist() for c in batch.columns]):
                if now is None or key != now.key:
                    if now is not None:
                        finish()
                    now = Conversation(key, told)
                if pos >= 0 and not gone:
                    now.row(turn, role, text)
                if rows:
                    done.extend(now.given)
                now.given.clear()
            if done:
                yield packed()
                done = []
        if now is not None:
            finish()
            if done:
                yield packed()

    dealt = stream.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "pos")
    return dealt.mapInArrow(run, ", ".join(fields))
