"""Conversation structure repair: lightest derivations by a best-first agenda.

A conversation is repaired by one edit a row (keep, rerole, delete) and inserted rows, so that the
role initials read ``(s?(ua)+)?``.  Items of the hypergraph are the edits of single rows (axioms) and
suffixes ``(level, state)``: the last ``level`` rows can be turned into what the machine accepts from
``state``.  Hyperedges derive a suffix from an edit and a shorter suffix, or from a suffix and an
insertion.  Weights are (cost, audit); a conclusion's cost is the sum of its antecedents' and its audit
the edit's initial before the suffix's audit.  The agenda pops by (cost, level, audit): every hyperedge
raises the cost or the level, and a letter put in front keeps the order of audits, so the functions
are superior and monotone, and the first pop of an item is its lightest derivation.  It stops when the
goal (all rows, start) is popped.  Audits are links to the antecedent, compared by letter and then by
the antecedents' rank in their level, so a conversation of n rows takes O(n log n) time and O(n) memory.

Rows come sorted by conversation to streaming tasks: one pass reads a few bytes and a digest a row and
writes the audit; a second pass reads the audit first and then the rows, and writes the repaired rows
one by one, so no text of a conversation is held beyond a batch.

Defined results: null role or text counts as one space, null turns come first; rows of one turn go by
(role, text); a null ``conv_id`` is a conversation of its own; a conversation that has no row left gets
zeros, an empty audit and no row; a repeated row is a duplicate (role and text seen earlier); texts of any
length are read whole; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
#: States: start, after system, after user, after assistant; initial -> (state before, state after).
MOVES = {"s": ((0, 1),), "u": ((0, 2), (1, 2), (3, 2)), "a": ((2, 3),)}
ACCEPT = (0, 3)
LEGAL = ("su", "ua", "au")
ROLE = {"u": "user", "a": "assistant"}
_NEXT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}

_SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_ROWS = "place long, edit string, role string, text string"


class _Way:
    """How an item was derived: an edit's letter and the suffix behind it."""

    __slots__ = ("letter", "behind", "ranks")

    def __init__(self, letter: str, behind: tuple[int, int] | None, ranks: list[dict[int, int]]):
        self.letter, self.behind, self.ranks = letter, behind, ranks

    def __lt__(self, other: _Way) -> bool:
        # within one level: equal letters have antecedents of one level, whose audits are ranked
        if self.letter != other.letter or not self.letter:
            return self.letter < other.letter
        (level, mine), (_, theirs) = self.behind, other.behind
        return self.ranks[level][mine] < self.ranks[level][theirs]


def lightest(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """(cost, audit) of the lightest repair of rows (role initial, fault)."""
    n = len(rows)
    ranks: list[dict[int, int]] = [{} for _ in range(n + 1)]
    finished: list[dict[int, tuple[int, _Way]]] = [{} for _ in range(n + 1)]
    edits: list[list[tuple[int, str, str]]] = [[] for _ in range(n + 1)]
    nothing = _Way("", None, ranks)
    # axioms: the empty suffix in accepting states, and the edits of each row (level -1: before all suffixes of their cost)
    agenda: list[tuple] = [(0, 0, nothing, state) for state in ACCEPT]
    for at, (initial, fault) in enumerate(rows):
        level = n - at
        agenda.append((DELETE, -1, nothing, (level, "D", "")))
        if fault not in (BLANK, DUPLICATE):
            extra = CUT if fault == TRUNCATED else 0
            if initial in MOVES:
                agenda.append((extra, -1, nothing, (level, "K", initial)))
            agenda += [(REROLE + extra, -1, nothing, (level, "R", out)) for out in ROLE]
    heapq.heapify(agenda)

    def conclude(edit: tuple[int, str, str], level: int, after: int) -> None:
        """The hyperedges from an edit of the row at ``level`` and the suffix (level - 1, after)."""
        cost, letter, out = edit
        cost += finished[level - 1][after][0]
        way = _Way(letter, (level - 1, after), ranks)
        for before in (after,) if not out else [b for b, a in MOVES[out] if a == after]:
            if before not in finished[level]:
                heapq.heappush(agenda, (cost, level, way, before))

    while agenda:
        cost, level, way, item = heapq.heappop(agenda)
        if level < 0:
            level, letter, out = item
            edits[level].append((cost, letter, out))
            for after in finished[level - 1]:
                conclude((cost, letter, out), level, after)
            continue
        if item in finished[level]:
            continue
        known = ranks[level]
        place = sum(finished[level][s][1] < way for s in known)
        for s in known:
            known[s] += known[s] >= place
        known[item], finished[level][item] = place, (cost, way)
        if level == n and item == 0:
            break
        if level < n:
            for edit in edits[level + 1]:
                conclude(edit, level + 1, item)
        for out in ROLE:
            for before in [b for b, a in MOVES[out] if a == item and b not in finished[level]]:
                heapq.heappush(agenda, (cost + INSERT, level, _Way("I", (level, item), ranks), before))
    total, way = finished[n][0]
    audit = []
    while way.letter:
        audit.append(way.letter)
        level, state = way.behind
        way = finished[level][state][1]
    return total, "".join(audit)


@lru_cache(maxsize=4096)
def _short(rows: tuple[tuple[str, int], ...]) -> tuple[int, str]:
    return lightest(list(rows))


class _Conversation:
    """What pass one keeps of a conversation: an initial, a fault and a digest a row."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int]] = []
        self.seen: set[tuple[int, int]] = set()
        self.first = self.last = None
        self.turns = self.illegal = 0

    def add(self, turn: int | None, initial: str, fault: int, digest: tuple[int, int]) -> None:
        again = digest in self.seen
        self.seen.add(digest)
        if self.rows and self.rows[-1][0] + initial not in LEGAL:
            self.illegal += 1
        self.rows.append((initial, fault if fault == BLANK else DUPLICATE if again else fault))
        if turn is not None:
            self.turns += self.last is None or turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn

    def summary(self, conv_id: int | None) -> tuple:
        cost, audit = _short(tuple(self.rows)) if len(self.rows) <= 64 else lightest(self.rows)
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        faults = [sum(f == k for _, f in self.rows) for k in (BLANK, DUPLICATE, TRUNCATED)]
        return (conv_id, gaps, *faults, self.illegal, cost, audit)


_SPACES = r"\x20\x09-\x0D"


def fault_of(text: Column) -> Column:
    """BLANK, TRUNCATED or 0 by the text alone."""
    return F.when(~text.rlike(rf"[^{_SPACES}]"), BLANK).when(~text.rlike(rf"[.!?][{_SPACES}]*\z"), TRUNCATED).otherwise(0)


def plain_rows(turns: DataFrame, gone: str | None = None) -> DataFrame:
    """conv_id, turn, role, text; null role and text are one space.  The column ``gone`` marks rows that only name their conversation."""
    gone = F.lit(False) if gone is None else F.col(gone)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"), gone.alias("gone"))


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, F.asc_nulls_first("turn"), "role", "text")


def summaries(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of every conversation of ``plain_rows``."""
    names = [x.split()[0] for x in _SUMMARY.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, out = (), None, []
        flush = lambda: pa.record_batch([pa.array(c, pa.string() if n == "audit" else pa.int64()) for c, n in zip(zip(*out, strict=True), names, strict=True)], names=names)
        for batch in batches:
            for conv_id, gone, turn, initial, fault, *digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own is None or now != (conv_id,):
                    if own is not None:
                        out.append(own.summary(*now))
                    now, own = (conv_id,), _Conversation()
                if not gone:
                    own.add(turn, initial, fault, tuple(digest))
            if out:
                yield flush()
                out = []
        if own is not None:
            out.append(own.summary(*now))
            yield flush()

    light = _in_order(rows).select("conv_id", "gone", "turn", F.substring("role", 1, 1).alias("initial"), fault_of(F.col("text")).alias("fault"), F.xxhash64("role", "text").alias("h1"), F.xxhash64("text", "role").alias("h2"))
    return light.mapInArrow(run, _SUMMARY)


def _repair_stream(rows: DataFrame) -> DataFrame:
    """A row with the summary (place -1) and then the repaired rows of each conversation, in order and in one task."""
    known = summaries(rows)
    heads = known.select(*known.columns, F.lit(0).alias("_ord"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"))
    bodies = rows.where(~F.col("gone")).select("conv_id", *(F.lit(None).cast("string" if c == "audit" else "long").alias(c) for c in known.columns[1:]), F.lit(1).alias("_ord"), "turn", "role", "text")
    schema = f"{_SUMMARY}, {_ROWS}"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in schema.split(", ")]
    none = [None] * (len(known.columns) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv_id, audit, at, state, place = None, "", 0, 0, 0

        def step(row: tuple[str, str] | None) -> None:
            """Inserts that come next, and the edit of ``row``."""
            nonlocal at, state, place
            while at < len(audit):
                letter = audit[at]
                if letter != "I" and row is None:
                    return
                at += 1
                if letter != "D":
                    role = row[0] if letter == "K" else ROLE["a" if state == 2 else "u"]
                    state = _NEXT[role[:1], state]
                    out.append((conv_id, *none, place, letter, role, "" if letter == "I" else row[1]))
                    place += 1
                if letter != "I":
                    return

        for batch in batches:
            for *head, order, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if order == 0:
                    step(None)
                    conv_id, audit, at, state, place = head[0], head[-1], 0, 0, 0
                    out.append((*head, -1, None, None, None))
                else:
                    step((role, text))
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        step(None)
        if out:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    both = _in_order(heads.unionByName(bodies), "_ord")
    return both.select(*known.columns, "_ord", "role", "text").mapInArrow(run, schema)


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit (K, R or I), role and text of the repaired conversations."""
    return _repair_stream(plain_rows(turns)).where("place >= 0").select("conv_id", "place", "edit", "role", "text")


def digests(turns: DataFrame, gone: str | None = None) -> DataFrame:
    """The summary of every conversation with the SHA-256 of its repaired ``role:text`` lines."""
    stream = _repair_stream(plain_rows(turns, gone))
    names = [*(x.split()[0] for x in _SUMMARY.split(", ")), "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, digest, out = None, None, []
        flush = lambda: pa.record_batch([pa.array(c, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for c, n in zip(zip(*out, strict=True), names, strict=True)], names=names)
        for batch in batches:
            for *summary, place, _, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place < 0:
                    if head is not None:
                        out.append((*head, digest.hexdigest()))
                    head, digest = summary, hashlib.sha256()
                else:
                    digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            if out:
                yield flush()
                out = []
        if head is not None:
            out.append((*head, digest.hexdigest()))
            yield flush()

    return stream.mapInArrow(run, f"{_SUMMARY}, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """Rows after damage by crc32(conv_id:turn) mod 20; a dropped row stays as ``gone``."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = plain_rows(turns).withColumn("_kind", F.crc32(F.encode(key, "UTF-8")) % 20)
    kind = F.col("_kind")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("_copy")
    # a dropped row only says that its conversation exists
    lost = lambda c: F.when(kind != 0, c)
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", lost(F.col("turn")).alias("turn"), lost(role).alias("role"), lost(text).alias("text"), (kind == 0).alias("gone"), times).drop("_copy")


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(damaged(table(spark, sf_dir, "conversations")), gone="gone")
