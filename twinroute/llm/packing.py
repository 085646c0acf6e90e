"""Best-fit packing of token sequences by a configuration linear program.

Texts become pieces of at most ``capacity`` tokens; only the histogram of piece lengths
(``capacity`` rows, whatever the corpus) reaches the driver.  There a configuration linear
program, one column for each way to fill a sequence, is solved by multiplicative weights:
lengths carry weights, a bounded knapsack dynamic program prices the configurations, and
lengths already covered lose weight.  The fractional plan is rounded by largest remainders, what is left is
solved again, and only a last rest is packed best-fit.  Spark then numbers the pieces of each length and looks their place up in
the plan; a piece never meets another piece of its sequence in memory.

Defined results: null text counts as empty and packs as one end token; rows that repeat an
id are separate documents in the plan (their pieces repeat); extra columns are ignored; an
empty table gives an empty result.  A longer text is cut so that only its first piece can be shorter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import materialise, table, text_and_id
from .words import slices

CAPACITY = 1024
END_ID = 2
BLOCK = 1 << 20
VOCABULARY = "byte_bpe_50k"


class Encoder:
    """Ids of a byte-level vocabulary.

    Texts of Latin letters and common punctuation go through the rank file of the same vocabulary, which
    gives the same ids several times faster; any other text goes through the tokenizer file.
    """

    def __init__(self, name: str = VOCABULARY):
        import base64
        import re

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        ranks = {}
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            for line in lines:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        self._fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._full = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        self._odd = re.compile("[^\\x09-\\x0d\\x20-\\x7e\\u00a1-\\u00ac\\u00ae-\\u024f\\u2010-\\u2027]|<\\|")

    def ids(self, text: str) -> np.ndarray:
        if self._odd.search(text):
            return np.asarray(self._full.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.asarray(self._fast.encode_to_numpy(text), dtype="<u4")


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and its ids on request."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(vocabulary)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            for part in slices(batch, "text"):
                rows: list[tuple] = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = np.concatenate([tokens.ids(text or ""), end])
                    first = (len(ids) - 1) % capacity + 1
                    cuts = [0, *range(first, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        rows.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), *([ids[a:b].astype(np.int32)] if with_ids else [])))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return text_and_id(docs).mapInArrow(run, schema)


def price(weights: np.ndarray, lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(weight, how often each length is taken) of the best configurations, no length more often than it occurs.

    A bounded knapsack dynamic program over the lengths of at most half the capacity; at most one longer length fits, so
    one program gives the best completion of every longer length, and the best without one.
    """
    short, long = np.flatnonzero(lengths <= capacity // 2)[::-1], np.flatnonzero(lengths > capacity // 2)
    best = np.zeros(capacity + 1)
    layers: list[tuple[int, int, np.ndarray]] = []
    for at in short:
        size, left, block = int(lengths[at]), int(min(counts[at], capacity // lengths[at])), 1
        while left:
            n = min(block, left)
            left, block = left - n, 2 * block
            total = best[: -n * size] + n * weights[at]
            taken = np.zeros(capacity + 1, dtype=bool)
            np.greater(total, best[n * size :] + 1e-12, out=taken[n * size :])
            best[n * size :] = np.maximum(best[n * size :], total)
            layers.append((at, n, taken))
    configs = np.zeros((len(long) + 1, len(lengths)), dtype=np.int32)
    configs[np.arange(len(long)), long] = 1
    room = np.r_[capacity - lengths[long], capacity]
    value = best[room] + np.r_[weights[long], 0]
    for at, n, taken in reversed(layers):
        hit = taken[room]
        configs[hit, at] += n
        room = np.where(hit, room - n * lengths[at], room)
    return value, configs


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, tolerance: float = 0.005, rounds: int = 120, step: float = 0.1) -> dict[tuple, float]:
    """A covering plan of the configuration program, {((index, times), ...): use}, by multiplicative weights.

    Each round prices the configurations under the weights and uses those of nearly the most weight so far that no length
    gains more than ``step`` of its count; lengths ahead of the others lose weight.  Any weights, divided by the most that a
    configuration weighs, are a dual solution, so the rounds end when the plan is within ``tolerance`` of the best dual value.
    """
    weights, load, covered = lengths / capacity, np.zeros(len(lengths)), np.zeros(len(lengths))
    plan: dict[tuple, float] = {}
    used = bound = 0.0
    for k in range(rounds):
        if k == rounds // 3:  # the first columns were priced before the weights had settled
            plan, used, covered = {}, 0.0, np.zeros(len(lengths))
        value, configs = price(weights, lengths, counts, capacity)
        bound = max(bound, float(counts @ weights) / value.max())
        near = configs[value >= (1 - 4 * tolerance) * value.max()]
        # all of a round together raise no length by more than the step
        per = counts / np.maximum(near.sum(axis=0), 1)
        use = step * np.where(near > 0, per, np.inf).min(axis=1)
        for config, x in zip(near, use, strict=True):
            own = np.flatnonzero(config)
            key = tuple(zip(own.tolist(), config[own].tolist(), strict=True))
            plan[key] = plan.get(key, 0.0) + float(x)
        used += float(use.sum())
        gain = use @ near / counts
        load, covered = load + gain, covered + gain
        weights = lengths / capacity * np.exp(-np.minimum(load - load.min(), 30))
        if covered.min() > 0 and used / covered.min() <= (1 + tolerance) * bound:
            break
    scale = 1 / covered.min() if covered.min() > 0 else 1 / max(covered.max(), 1e-9)
    return {k: x * scale for k, x in plan.items()}


def best_fit(sizes: Counter, capacity: int, begun: Counter | None = None) -> Counter:
    """Best-fit decreasing over counted lengths, into the begun configurations first: configurations (tuples) with their numbers.

    Whole runs of equal lengths are placed at once, so the work follows the distinct lengths
    and fill levels and not the number of pieces.
    """
    room: dict[int, Counter] = {capacity: Counter()}  # left over -> configurations
    done: Counter = Counter()
    for config, n in (begun or {}).items():
        room.setdefault(capacity - sum(config), Counter())[config] += n
    for size in sorted(sizes, reverse=True):
        left = sizes[size]
        while left:
            fits = [r for r in room if size <= r < capacity and room[r]]
            if fits:
                r = min(fits)
                config, n = next(iter(room[r].items()))
                n = min(n, left)
                room[r][config] -= n
                if not room[r][config]:
                    del room[r][config]
                room.setdefault(r - size, Counter())[(*config, size)] += n
                left -= n
            else:
                per = capacity // size
                whole, rest = divmod(left, per)
                if whole:
                    room.setdefault(capacity - per * size, Counter())[(size,) * per] += whole
                if rest:
                    room.setdefault(capacity - rest * size, Counter())[(size,) * rest] += 1
                left = 0
    for configs in room.values():
        done.update(configs)
    return done


def plan(histogram: dict[int, int], capacity: int = CAPACITY, dives: int = 12) -> Counter:
    """Configurations (tuples of lengths) and how often to use each, covering the histogram exactly.

    The fractional plan is rounded down; then the largest remainders take one more where their lengths are still
    there.  What is left is solved again, and a rest that no configuration fits, or that is left after ``dives`` solutions,
    goes best-fit into the room of the begun sequences.
    """
    histogram = {k: v for k, v in histogram.items() if v}
    out: Counter = Counter()
    full = histogram.pop(capacity, 0)
    left = Counter(histogram)
    for _ in range(dives):
        lengths = np.array(sorted(+left), dtype=np.int64)
        if not len(lengths):
            break
        counts = np.array([left[int(x)] for x in lengths], dtype=float)
        shares = fractional(lengths, counts, capacity)
        taken = 0
        by_use = sorted(shares.items(), key=lambda x: (-int(x[1]), -(x[1] % 1), x[0]))
        for rounding in ("down", "remainder"):
            for key, use in by_use if rounding == "down" else sorted(by_use, key=lambda x: (-(x[1] % 1), x[0])):
                config = {int(lengths[at]): n for at, n in key}
                fits = min(left[s] // n for s, n in config.items())
                n = min(int(use), fits) if rounding == "down" else min(1, fits)
                if n > 0:
                    out[tuple(sorted((s for s, k in config.items() for _ in range(k)), reverse=True))] += n
                    for s, k in config.items():
                        left[s] -= n * k
                    taken += n
        if not taken:
            break
    out = best_fit(+left, capacity, out)
    if full:
        out[(capacity,)] += full
    return out


def slots(configs: Counter) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, number, first sequence, offset): where the pieces of a length go, in order of rank."""
    found, used, sequence = [], Counter(), 0
    for config, n in sorted(configs.items(), reverse=True):
        offset = 0
        for size in config:
            found.append((size, used[size], n, sequence, offset))
            used[size] += n
            offset += size
        sequence += n
    return found


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset.  ``cut`` should be materialised: it is read twice."""
    spark = cut.sparkSession
    # Equal lengths are numbered in blocks of about BLOCK pieces, so one very common length is not one task's work.
    many = {r["length"]: r["count"] // BLOCK + 8 for r in cut.groupBy("length").count().collect()}  # capacity rows at most
    shares = spark.createDataFrame(sorted(many.items()), "length long, share long")
    marked = cut.join(F.broadcast(shares), "length").withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), "share").cast("int")).drop("share")
    sized = marked.groupBy("length", "block").agg(F.count("*").alias("n")).collect()  # eight rows a length and one for BLOCK pieces
    histogram, base = Counter(), []
    for row in sorted(sized):
        base.append((row["length"], row["block"], histogram[row["length"]]))
        histogram[row["length"]] += row["n"]
    places = slots(plan(dict(histogram), capacity))
    starts = spark.createDataFrame(base, "length long, block int, base long")
    spread = spark.createDataFrame(places, "length long, first long, number long, sequence long, offset long")
    order = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "start")
    ranked = marked.join(F.broadcast(starts), ["length", "block"]).withColumn("rank", F.col("base") + F.row_number().over(order) - 1)
    # each length has its few place runs in one array: the lookup is a broadcast of plan rows, not a range join
    runs = spread.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first", "number", "sequence", "offset"))).alias("runs"))
    placed = ranked.join(F.broadcast(runs), "length")
    hit = F.element_at(F.filter("runs", lambda r: (r["first"] <= F.col("rank")) & (F.col("rank") < r["first"] + r["number"])), 1)
    names = [c for c in cut.columns]
    found = placed.withColumn("hit", hit)
    return found.select(*names, (F.col("hit.sequence") + F.col("rank") - F.col("hit.first")).alias("sequence_id"), F.col("hit.offset").alias("offset"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(materialise(pieces(table(spark, sf_dir, "documents"))))
