"""Language-model scoring with a hashed maximum-entropy model.

P(token | history) = P(group | h) P(class | group, h) P(token | class).  The first two are
softmaxes over features of the history: the token before, the pair before, and the skipped second and
third tokens before, each as the hash of the tokens themselves.  A feature has a row of weights over the
groups and one over the classes of each group; rows are picked by the hash of (feature) and of (feature,
group) from one table of ``ROWS`` rows, whatever the vocabulary.  Frequent tokens are classes of their own
and the rest fall into classes by their first bytes, with add-one counts inside a class and one share for
unseen tokens, so the probabilities of all tokens sum to one.

Training: every task runs gradient steps over its own training tokens from the sent
weights; the updates are summed by row, weighted by how often each task met the row,
and the next round starts from the result (so weights depend a little on how rows are dealt to tasks).  Counts come from all training tokens.  Scoring
turns slices of texts into sparse index batches; a token's corpus count reaches its texts by a join
on the token, entered once a block of texts, so no table of the vocabulary is ever sent to the tasks.

Sent to the tasks are only the weights (a fixed size) and the frequent tokens (``TOP``).
Tokens are compared by a 64-bit hash of their bytes.

Defined results: null text counts as empty (one end token); a null id is neither held out nor learned
from; repeated rows are scored separately; extra columns are ignored; an empty table gives an empty
result, and without training texts every token is unseen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .language_id import remainder
from .tables import materialise, table, text_and_id
from .words import lower_ascii, mix, signed, slices, split

GROUPS = WIDTH = 16
CLASSES = GROUPS * WIDTH
TOP = 192
#: Rows of weights, and those of a packed block of updates.
ROW_BITS = 17
ROWS = 1 << ROW_BITS
PACK = 256
END = np.uint64(0x2545F4914F6CDD1D)
START = np.uint64(0x9FB21C651E98DF25)
#: Odd multipliers: one a kind of feature, one for the group.
KINDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
OF_GROUP = np.uint64(0xA24BAED4963EE407)
BATCH = 1 << 14
#: Tokens of a block: texts whose rarer tokens enter the join together.
BLOCK_TOKENS = 1 << 20
HELD_KEYS = 1 << 18
#: Rows of an Arrow batch, and triples of a block row, at most.
BATCH_ROWS = 1 << 14


@dataclass
class Tokens:
    """Tokens of a slice with an end after each text: text d has first[d]:first[d+1]."""

    hash: np.ndarray
    bucket: np.ndarray
    first: np.ndarray


def tokenize(texts: pa.Array) -> Tokens:
    words = split(texts, fold=lower_ascii)
    n, docs = len(words.start), len(words.first) - 1
    place = np.arange(n) + words.doc_of()
    hashes, bucket = np.full(n + docs, END), np.zeros(n + docs, dtype=np.int64)
    hashes[place] = words.hash
    head = words.data[words.start].astype(np.int64)
    second = np.where(words.end - words.start > 1, words.data[np.minimum(words.start + 1, max(len(words.data) - 1, 0))], 0) if n else head
    bucket[place] = TOP + (head * 31 + second * 7) % (CLASSES - TOP)
    return Tokens(hashes, bucket, words.first + np.arange(docs + 1))


def _merged(keys: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, ...]:
    own, at = np.unique(keys, return_inverse=True)
    return own, *(np.bincount(at, weights=s, minlength=len(own)) for s in sums)


def count(training: DataFrame) -> DataFrame:
    """(token, bucket, n) of every distinct training token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            keys, buckets, n = (np.concatenate(x) for x in zip(*held, strict=True))
            own, at, where = np.unique(keys, return_index=True, return_inverse=True)
            return pa.record_batch([pa.array(signed(own)), pa.array(buckets[at].astype(np.int32)), pa.array(np.bincount(where, weights=n).astype(np.int64))], names=["token", "bucket", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                t = tokenize(part.column("text"))
                own, at, n = np.unique(t.hash, return_index=True, return_counts=True)
                held.append((own, t.bucket[at], n))
                size += len(own)
                if size > HELD_KEYS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    seen = training.select("text").mapInArrow(run, "token long, bucket int, n long")
    return seen.groupBy("token").agg(F.min("bucket").alias("bucket"), F.sum("n").alias("n"))


@dataclass
class Model:
    """Frequent tokens, class statistics and the weights of both softmaxes."""

    top: np.ndarray  # sorted hashes
    top_class: np.ndarray
    top_count: np.ndarray
    train_tokens: int
    vocabulary: int
    inside: np.ndarray  # log10 of the denominator inside each class
    group_bias: np.ndarray
    class_bias: np.ndarray  # (groups, width)
    weights: np.ndarray  # (ROWS, 16): rows over groups and rows over the classes of a group

    def classes(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """(class, place among the frequent tokens or -1) of every token."""
        at = np.minimum(np.searchsorted(self.top, t.hash), len(self.top) - 1)
        own = self.top[at] == t.hash
        return np.where(own, self.top_class[at], t.bucket), np.where(own, at, -1)


def histories(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Feature hashes of every position: (4, tokens)."""
    n = len(hashes)
    place = np.arange(n) - np.repeat(first[:-1], np.diff(first))
    back = []
    for k in (1, 2, 3):
        older = np.full(n, START)
        older[k:] = hashes[:-k]
        older[place < k] = START
        back.append(older)
    return np.stack([back[0] * KINDS[0], mix(back[0] * KINDS[1] + back[1]), back[1] * KINDS[2], back[2] * KINDS[3]])


def rows_of(f: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Rows of weights of every position: (8, tokens), four over groups and then four over the classes of the group."""
    shift = np.uint64(64 - ROW_BITS)
    over_groups = (f * KINDS[1]) >> shift
    over_classes = ((f ^ ((group.astype(np.uint64) + np.uint64(1)) * OF_GROUP)) * KINDS[0]) >> shift
    return np.concatenate([over_groups, over_classes]).astype(np.int32)


def _softmax(x: np.ndarray) -> np.ndarray:
    """Row softmax, in place; logits stay small, so only the row's mean is taken off."""
    x -= x.mean(axis=1, keepdims=True)
    np.minimum(x, 80, out=x)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


class Room:
    """Arrays that batches of one task use again and again: fresh ones cost more than the sums in them."""

    def __init__(self):
        self._held: dict[str, np.ndarray] = {}

    def taken(self, name: str, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        """values[at], rows, in the array of that name."""
        held = self._held.get(name)
        if held is None or len(held) < len(at):
            held = self._held[name] = np.empty((max(len(at), BATCH), WIDTH), np.float32)
        return np.take(values, at, axis=0, out=held[: len(at)], mode="clip")


def chances(m: Model, rows: np.ndarray, ids: np.ndarray, room: Room | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group probabilities, class probabilities in the own group, log10 of the class's probability)."""
    room = room or Room()
    group, inner = ids // WIDTH, ids % WIDTH
    a, b = room.taken("a", m.group_bias[None], np.zeros(len(ids), np.int8)), room.taken("b", m.class_bias, group)
    kinds = len(KINDS)
    for k in range(kinds):
        a += room.taken("row", m.weights, rows[k])
        b += room.taken("row", m.weights, rows[kinds + k])
    p, q = _softmax(a), _softmax(b)
    at = np.arange(len(ids))
    return p, q, np.log10(p[at, group] * q[at, inner] + 1e-300)


def descend(m: Model, squares: np.ndarray, met: np.ndarray, rows: np.ndarray, p: np.ndarray, q: np.ndarray, rate: float, room: Room) -> None:
    """One adaptive gradient step of a batch on the rows it met; p, q: slopes of both softmaxes; met: how often a row was met."""
    n = rows.shape[1]
    flat = rows.ravel()
    order = np.argsort(flat)
    flat = flat.take(order)
    heads = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    own = flat.take(heads)
    # the first half of the rows steps by p, the second by q
    at = order % n
    at += n * (order >= len(KINDS) * n)
    slopes = room.taken("slopes", np.concatenate([p, q]), at)
    sums = room.taken("sums", slopes, heads)
    # most rows are met once in a batch; only the others are added up
    times = np.diff(np.r_[heads, len(flat)])
    often = np.flatnonzero(times > 1)
    if len(often):
        several = times[often]
        parts = room.taken("parts", slopes, np.flatnonzero(np.repeat(times > 1, times)))
        sums[often] = np.add.reduceat(parts, np.cumsum(several) - several, axis=0)
    square = room.taken("square", squares, own)
    square += np.multiply(sums, sums, out=slopes[: len(own)])
    squares[own] = square
    np.sqrt(square, out=square)
    sums *= -rate
    sums /= square
    moved = room.taken("square", m.weights, own)
    moved += sums
    m.weights[own] = moved
    met[own] += times


def epoch(training: DataFrame, model: Model, rate: float) -> Model:
    """One round of distributed gradient updates over all training tokens."""
    sent = training.sparkSession.sparkContext.broadcast(model)

    def improve(batches):
        m = sent.value
        own = replace(m, weights=m.weights.copy())
        squares, met, room = np.ones_like(own.weights), np.zeros(ROWS, dtype=np.float32), Room()
        for batch in batches:
            for part in slices(batch, "text"):
                t = tokenize(part.column("text"))
                ids, _ = own.classes(t)
                feats = histories(t.hash, t.first)
                for lo in range(0, len(ids), BATCH):
                    y = ids[lo : lo + BATCH]
                    rows = rows_of(feats[:, lo : lo + BATCH], y // WIDTH)
                    p, q, _ = chances(own, rows, y, room)
                    at = np.arange(len(y))
                    p[at, y // WIDTH] -= 1
                    q[at, y % WIDTH] -= 1
                    descend(own, squares, met, rows, p, q, rate, room)
        own.weights -= m.weights
        # a pack: its met rows (one byte each), how often, and their steps
        for pack in np.unique(np.flatnonzero(met) // PACK):
            here = slice(pack * PACK, (pack + 1) * PACK)
            used = np.flatnonzero(met[here])
            packed = (used.astype(np.uint8), met[here][used], own.weights[here][used].astype("<f2"))
            yield pa.record_batch([pa.array([pack]), *(pa.array([x.tobytes()], pa.binary()) for x in packed)], names=["pack", "used", "met", "moved"])

    def add(batches):
        total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for pack, used, met, moved in zip(*(batch.column(c).to_pylist() for c in ("pack", "used", "met", "moved")), strict=True):
                steps, times = total.setdefault(pack, (np.zeros((PACK, WIDTH)), np.zeros(PACK)))
                used, met = np.frombuffer(used, np.uint8), np.frombuffer(met, "<f4")
                steps[used] += np.frombuffer(moved, "<f2").reshape(-1, WIDTH) * met[:, None]
                times[used] += met
        for pack, (steps, times) in total.items():
            mean = (steps / np.maximum(times, 1)[:, None]).astype("<f4")
            yield pa.record_batch([pa.array([pack]), pa.array([mean.tobytes()], pa.binary())], names=["pack", "moved"])

    updates = training.select("text").mapInArrow(improve, "pack long, used binary, met binary, moved binary").repartition("pack").mapInArrow(add, "pack long, moved binary")
    weights = model.weights.copy()
    for row in updates.collect():  # ROWS / PACK rows at most
        weights[row["pack"] * PACK : (row["pack"] + 1) * PACK] += np.frombuffer(row["moved"], "<f4").reshape(PACK, WIDTH)
    sent.unpersist()
    return replace(model, weights=weights)


def start(counts: DataFrame) -> Model:
    """The model before training: counts and class frequencies, no feature weight."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    best = counts.orderBy(F.desc("n"), "token").limit(TOP).collect()
    found = {np.int64(r["token"]).astype(np.uint64): r["n"] for r in best}
    found.setdefault(END, 0)
    ranked = sorted(found, key=lambda h: (h != END, -found[h], h))[:TOP]
    own_class = {h: k for k, h in enumerate(ranked)}
    top = np.array(sorted(ranked), dtype=np.uint64)
    rest = counts.where(~F.col("token").isin([int(signed(np.array([h]))[0]) for h in ranked]))
    by_class = rest.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    mass, inside = np.ones(CLASSES), np.zeros(CLASSES)
    for h, k in own_class.items():
        mass[k] += found[h]
    for row in by_class:
        mass[row["bucket"]] += row["n"]
        inside[row["bucket"]] = np.log10(row["n"] + row["v"] + 1)
    shared = mass.reshape(GROUPS, WIDTH)
    return Model(
        top, np.array([own_class[h] for h in top]), np.array([found[h] for h in top]), int(total["n"]), int(total["v"]), inside,
        np.log(shared.sum(axis=1) / shared.sum()).astype(np.float32), np.log(shared / shared.sum(axis=1, keepdims=True)).astype(np.float32),
        np.zeros((ROWS, WIDTH), np.float32),
    )


def train(training: DataFrame, epochs: int = 1, rate: float = 0.3) -> tuple[Model, DataFrame]:
    """The model and the counts (token, bucket, n) it stands on."""
    counts = materialise(count(training))
    model = start(counts)
    for k in range(epochs):
        model = epoch(training, model, rate / (k + 1))
    return model, counts


ENTERED = "kind string, block long, slot int, token long, place int, places binary, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


def enter(docs: DataFrame, model: Model) -> DataFrame:
    """Texts with what the model alone knows of them, and the places of their other tokens.

    ``text`` rows: the sums over frequent tokens and the class probabilities.  ``token`` rows, one for a token and
    block, with its place among the block's tokens.  ``block`` rows: the (place, slot, times) of its tokens in its texts.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        from pyspark import TaskContext

        m = sent.value
        floor = np.log10(m.train_tokens + m.vocabulary + 1)
        kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
        fields = [x.split() for x in ENTERED.split(", ")]

        def row_batch(kind, n, **columns):
            columns["kind"] = pa.array([kind] * n, pa.string())
            return pa.record_batch([columns.get(name, pa.nulls(n, kinds[k])) for name, k in fields], names=[name for name, _ in fields])

        block, slots, rare, where, size = TaskContext.get().partitionId() << 32, 0, [], [], 0
        log_top, room = np.log10(m.top_count + 1), Room()

        def flush():
            keys, at = np.concatenate(rare), np.concatenate(where)
            order = np.lexsort((at, keys))
            keys, at = keys[order], at[order]
            heads = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (at[1:] != at[:-1])]) if len(keys) else np.zeros(0, np.int64)
            times = np.diff(np.r_[heads, len(keys)])
            tokens = keys[heads]
            new = np.r_[True, tokens[1:] != tokens[:-1]] if len(tokens) else np.zeros(0, bool)
            tokens, place = tokens[new], np.cumsum(new) - 1
            triples = np.stack([place, at[heads], times], axis=1).astype("<u4")
            for lo in range(0, len(tokens), BATCH_ROWS):
                part = np.arange(lo, min(lo + BATCH_ROWS, len(tokens)), dtype=np.int32)
                yield row_batch("token", len(part), block=pa.array(np.full(len(part), block)), token=pa.array(signed(tokens[part])), place=pa.array(part))
            for lo in range(0, len(triples), BATCH_ROWS):
                yield row_batch("block", 1, block=pa.array([block]), places=pa.array([triples[lo : lo + BATCH_ROWS].tobytes()], pa.binary()))

        for batch in batches:
            for part in slices(batch, "text"):
                t = tokenize(part.column("text"))
                docs_here = part.num_rows
                ids, place = m.classes(t)
                doc = np.repeat(np.arange(docs_here), np.diff(t.first))
                feats = histories(t.hash, t.first)
                part_rows = lambda lo: rows_of(feats[:, lo : lo + BATCH], ids[lo : lo + BATCH] // WIDTH)
                logs = np.concatenate([chances(m, part_rows(lo), ids[lo : lo + BATCH], room)[2] for lo in range(0, len(ids), BATCH)])
                own = place >= 0
                known_top = own & (m.top_count[place] > 0)
                known = np.bincount(doc[known_top], minlength=docs_here)
                base = np.bincount(doc[own], weights=log_top[place[own]], minlength=docs_here) - floor * np.diff(t.first)
                score = np.bincount(doc, weights=logs - np.where(own, 0, m.inside[ids]), minlength=docs_here)
                n = docs_here
                yield row_batch(
                    "text", n, block=pa.array(np.full(n, block)), slot=pa.array(np.arange(slots, slots + n, dtype=np.int32)), doc_id=part.column("doc_id"), held_out=part.column("held_out"),
                    n_tokens=pa.array(np.diff(t.first)), n_known=pa.array(known.astype(np.int64)), base=pa.array(base), score=pa.array(score),
                )
                rare.append(t.hash[~own])
                where.append((doc[~own] + slots).astype(np.uint32))
                size += len(rare[-1])
                slots += n
                if size > BLOCK_TOKENS:
                    yield from flush()
                    block, slots, rare, where, size = block + 1, 0, [], [], 0
        if rare:
            yield from flush()

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, ENTERED)


def gather(entered: DataFrame, counts: DataFrame) -> DataFrame:
    """(block, slot, more, more_known): what the joined counts add to each text.

    The counts of a block's tokens come back to the block and stream past in order, the block's places after them,
    so a task holds the counts of one block and its sums, both of which are bounded.
    """

    def add(batches):
        block, n, more, known = None, np.zeros(0, np.int64), np.zeros(0), np.zeros(0)

        def out():
            return pa.record_batch([pa.array(np.full(len(more), block)), pa.array(np.arange(len(more), dtype=np.int32)), pa.array(more), pa.array(known.astype(np.int64))], names=["block", "slot", "more", "more_known"])

        def grown(x, size):
            return x if len(x) >= size else np.concatenate([x, np.zeros(max(size, 2 * len(x)) - len(x), x.dtype)])

        for batch in batches:
            ids = batch.column("block").to_numpy()
            edges = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                if ids[lo] != block:
                    if len(more):
                        yield out()
                    block, n, more, known = int(ids[lo]), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
                part = batch.slice(lo, hi - lo)
                counted = part.filter(part.column("places").is_null())
                if counted.num_rows:
                    place = counted.column("place").to_numpy()
                    n = grown(n, int(place.max()) + 1)
                    n[place] = counted.column("n").to_numpy()
                for places in part.column("places").drop_null():
                    triples = np.frombuffer(places.as_buffer(), "<u4").reshape(-1, 3)
                    slot, times = triples[:, 1], triples[:, 2]
                    n = grown(n, int(triples[:, 0].max()) + 1)
                    of, size = n[triples[:, 0]], int(slot.max()) + 1
                    more, known = grown(more, size), grown(known, size)
                    more[:size] += np.bincount(slot, weights=times * np.log10(of + 1), minlength=size)
                    known[:size] += np.bincount(slot, weights=times * (of > 0), minlength=size)
        if len(more):
            yield out()

    # unseen tokens add nothing: log10(0 + 1)
    found = entered.where("kind = 'token'").select("token", "block", "place").join(counts.select("token", "n"), "token")
    back = found.select("block", "place", "n", F.lit(None).cast("binary").alias("places"))
    blocks = entered.where("kind = 'block'").select("block", F.lit(None).cast("int").alias("place"), F.lit(None).cast("long").alias("n"), "places")
    ordered = back.unionByName(blocks).repartition("block").sortWithinPartitions("block", F.col("place").asc_nulls_last())
    return ordered.mapInArrow(add, "block long, slot int, more double, more_known long")


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs (doc_id, held_out, text)."""
    entered = materialise(enter(docs, model))
    texts = entered.where("kind = 'text'")
    more = gather(entered, counts)
    plus = lambda c, m: (F.col(c) + F.coalesce(m, F.lit(0))).alias(c)
    joined = texts.join(more, ["block", "slot"], "left")
    return joined.select("doc_id", "held_out", "n_tokens", plus("n_known", F.col("more_known")), F.lit(model.train_tokens).cast("long").alias("train_tokens"), plus("base", F.col("more")).alias("base_score"), plus("score", F.col("more")))


def op8_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = remainder(F.col("doc_id"), 7)
    docs = text_and_id(table(spark, sf_dir, "documents")).withColumn("held_out", F.coalesce(part == 2, F.lit(False)))
    model, counts = train(docs.where("doc_id IS NOT NULL AND NOT held_out"))
    return score(docs, model, counts)
