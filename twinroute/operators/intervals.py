"""Interval algebra on half-open intervals: binned joins, and merge, subtract and depth by a two-level sweep.

Everything is keyed (chromosome, strand, transcript ...) and cut into bins inside a key: joins meet in a bin, and
sweeps order positions inside a bin only, so a chromosome of a library that holds most intervals is
spread like any other.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinroute.operators.unions import stacked

#: Bin width in bases: about the longest common interval.
BIN = 1024
#: Bin width of sweeps: a window orders the positions of so many bases.
SWEEP = 1 << 16


def bins(start: Column, end: Column, width: int) -> Column:
    """Numbers of the bins that [start, end) touches; none for an empty interval."""
    first, last = F.floor(start / width), F.floor((end - 1) / width)
    return F.when(end > start, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def overlap_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str], width: int = BIN
) -> DataFrame:
    """Pairs of overlapping intervals with equal ``on``, each once.

    An equi-join on (keys, bin) instead of a join on the few, hot keys alone.  A pair that shares several
    bins is kept in the one where the later start lies, which needs no distinct.  The columns of both sides other
    than ``on`` must differ in name.
    """
    ls, le, rs, re = (F.col(c) for c in (*left_span, *right_span))
    a = left.withColumn("_bin", F.explode(bins(ls, le, width)))
    b = right.withColumn("_bin", F.explode(bins(rs, re, width)))
    met = a.join(b, [*on, "_bin"]).where((ls < re) & (rs < le))
    return met.where(F.col("_bin") == F.floor(F.greatest(ls, rs) / width)).drop("_bin")


def point_join(left: DataFrame, right: DataFrame, on: Sequence[str], point: str, span: tuple[str, str], width: int = BIN) -> DataFrame:
    """Points of left with the intervals of right that hold them."""
    p, s, e = F.col(point), F.col(span[0]), F.col(span[1])
    a = left.withColumn("_bin", F.floor(p / width))
    b = right.withColumn("_bin", F.explode(bins(s, e, width)))
    return a.join(b, [*on, "_bin"]).where((s <= p) & (p < e)).drop("_bin")


def overlap_length(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start)).cast("long")


def overlap_counts(
    items: DataFrame, spans: DataFrame, by: Sequence[str], on: Sequence[str], item: tuple[str, str] = ("pos", "epos"), span: tuple[str, str] = ("s", "e"), width: int = SWEEP
) -> DataFrame:
    """(by, on, span, n): the sum of ``n`` over the items that overlap each distinct span, for every ``by``; no pair is formed.

    What overlaps a span began before its end, less what ended by its start.  Ends of spans are events without weight in the sweep over the
    items' ends.  The values of ``by`` must be few.
    """
    (i0, i1), (s0, s1) = item, span
    keys = [*by, *on]
    side = lambda c, s, e: F.struct(F.col(c).cast("long").alias("_x"), s.cast("long").alias("_s"), e.cast("long").alias("_e"))
    zero, n = F.lit(0), F.col("n")
    ends = F.explode(F.array(side(i0, n, zero), side(i1, zero, n))).alias("_v")
    # nulls go first: a join further on would take them out of one reader's input only, and the shuffles would differ
    real = reduce(Column.__and__, (F.col(c).isNotNull() for c in on))
    items, spans = items.where(real), spans.where(real)
    moved = items.where(F.col(i0) < F.col(i1)).select(*keys, ends).groupBy(*keys, F.col("_v._x").alias("_x")).agg(F.sum("_v._s").alias("_s"), F.sum("_v._e").alias("_e"))
    # told from the sums, so that the shuffle below is the one that the sweep reads
    present = moved.where("_s <> 0 OR _e <> 0").select(*by).distinct()
    edge = lambda c, ends_: F.struct(F.col(c).cast("long").alias("_x"), F.lit(ends_).alias("_ends"))
    edges = spans.where(F.col(s0) < F.col(s1)).select(*on, s0, s1).distinct().select(*on, s0, s1, F.explode(F.array(edge(s0, False), edge(s1, True))).alias("_v")).select(*on, s0, s1, "_v.*")
    asked = edges.select(*on, "_x").distinct().join(F.broadcast(present)).select(*keys, "_x", *(F.lit(k).cast("long").alias(c) for c, k in (("_s", 0), ("_e", 0), ("_q", 1))))
    changes = stacked(moved.select(*keys, "_x", "_s", "_e", zero.cast("long").alias("_q")), asked).groupBy(*keys, F.col("_x").alias("pos")).agg(*(F.sum(c).alias(c) for c in ("_s", "_e", "_q")))
    ran = sweep(changes, keys, ("_s", "_e", "_q"), width).where("_d__q > 0").select(*keys, F.col("pos").alias("_x"), (F.col("_s") - F.col("_d__s")).alias("_begun"), F.col("_e").alias("_ended"))
    found = edges.join(ran, [*on, "_x"]).groupBy(*keys, s0, s1).agg(F.sum(F.when(F.col("_ends"), F.col("_begun")).otherwise(-F.col("_ended"))).alias("n"))
    return found.where("n <> 0")


def merge(spans: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", width: int | None = SWEEP) -> DataFrame:
    """Union of the intervals of each key; touching ones merge.  Empty intervals vanish."""
    here, before = F.col("_one") > 0, F.col("_one") - F.col("_d__one") > 0
    return _islands(events(spans, keys, start, end), keys, ("_one",), here, before, width).select(*keys, F.col("pos").alias(start), F.col("_next").alias(end))


def merged_length(spans: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", width: int | None = SWEEP) -> DataFrame:
    """Bases that the union of each key's intervals covers."""
    return merge(spans, keys, start, end, width).groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).cast("long").alias("n_bases"))


def events(spans: DataFrame, keys: Sequence[str], start: str, end: str, weights: tuple[str, ...] = ("_one",)) -> DataFrame:
    """Sums of +weight at starts and -weight at ends by position; positions where nothing changes vanish."""
    sides = F.array(*(F.struct(F.col(c).cast("long").alias("pos"), F.lit(s).alias("sign")) for c, s in ((start, 1), (end, -1))))
    sided = spans.where(F.col(end) > F.col(start)).withColumn("_one", F.lit(1)).withColumn("_e", F.explode(sides))
    summed = sided.groupBy(*keys, F.col("_e.pos").alias("pos")).agg(*(F.sum(F.col(w) * F.col("_e.sign")).alias(w) for w in weights))
    return summed.where(reduce(Column.__or__, (F.col(w) != 0 for w in weights)))


def sweep(changes: DataFrame, keys: Sequence[str], values: Sequence[str] = (), width: int | None = SWEEP) -> DataFrame:
    """changes (keys, pos, values; one row a position) with running sums of values, ``_d_`` value (the event's own) and ``_next``, the next position.

    Two levels: the sums and first positions of bins of ``width`` bases are carried from bin to bin over one row a bin; each
    bin then gets what came before it as a row in front and the next bin's first position as a row behind, so the
    events themselves are only ordered inside a bin and a hot key is spread over its bins.  Without a width a key is one
    bin, which is for keys that an annotation bounds (the exons of a gene or transcript).
    """
    own = [F.col(v).alias(f"_d_{v}") for v in values]
    if width is None:
        order = Window.partitionBy(*keys).orderBy("pos")
        so_far = order.rowsBetween(Window.unboundedPreceding, 0)
        return changes.select(*keys, "pos", *own, *(F.sum(v).over(so_far).cast("long").alias(v) for v in values), F.lead("pos").over(order).alias("_next"))
    kinds = dict(changes.dtypes)
    # an alias of what is long already would make equal shuffles differ
    long = lambda c: F.col(c) if kinds[c] == "bigint" else F.col(c).cast("long").alias(c)
    binned = changes.select(*keys, F.floor(F.col("pos") / width).alias("_bin"), F.lit(1).alias("_k"), long("pos"), *(long(v) for v in values))
    over = Window.partitionBy(*keys).orderBy("_bin")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    bins_ = binned.groupBy(*keys, "_bin").agg(F.min("pos").alias("_first"), *(F.sum(v).alias(v) for v in values))
    carried = bins_.select(*keys, "_bin", F.lead("_first").over(over).alias("_then"), *(F.coalesce(F.sum(v).over(before), F.lit(0)).alias(v) for v in values))
    edge = lambda k, pos, vs: F.struct(F.lit(k).alias("_k"), pos.alias("pos"), *(x.cast("long").alias(v) for v, x in zip(values, vs, strict=True)))
    edges = carried.select(*keys, "_bin", F.explode(F.array(edge(0, F.lit(None).cast("long"), [F.col(v) for v in values]), edge(2, F.col("_then"), [F.lit(0)] * len(values)))).alias("_e")).select(*keys, "_bin", "_e.*")
    order = Window.partitionBy(*keys, "_bin").orderBy("_k", "pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    ran = stacked(binned, edges).select(*keys, "_k", "pos", *own, *(F.sum(v).over(so_far).alias(v) for v in values), F.lead("pos").over(order).alias("_next"))
    return ran.where("_k = 1").drop("_k")


def _islands(changes: DataFrame, keys: Sequence[str], values: Sequence[str], here: Column, before: Column, width: int | None) -> DataFrame:
    """(keys, pos, _next): the maximal stretches where ``here`` holds of the running sums; ``before`` is the same of the sums before an event."""
    edges = sweep(changes, keys, values, width).select(*keys, "pos", here.alias("_here"), before.alias("_before")).where("_here <> _before")
    ends = sweep(edges.select(*keys, "pos", F.col("_here").cast("long").alias("_opens")), keys, ("_opens",), width)
    return ends.where("_d__opens = 1").select(*keys, "pos", "_next")


def depth(spans: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", width: int | None = SWEEP, weight: str = "_one") -> DataFrame:
    """Run-length segments (start, end, depth) with depth over 0: neighbours of equal depth are one segment.  ``weight``: a column that says how many a span stands for."""
    ran = sweep(events(spans, keys, start, end, (weight,)), keys, (weight,), width)
    return ran.where(F.col(weight) > 0).select(*keys, F.col("pos").alias("start"), F.col("_next").alias("end"), F.col(weight).alias("depth"))


def subtract(spans: DataFrame, holes: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", width: int | None = SWEEP) -> DataFrame:
    """The union of spans without the union of holes, by key."""
    both = stacked(spans.select(*keys, start, end, F.lit(1).alias("_a"), F.lit(0).alias("_b")), holes.select(*keys, start, end, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    left = lambda a, b: (a > 0) & (b == 0)
    a, b, da, db = (F.col(x) for x in ("_a", "_b", "_d__a", "_d__b"))
    found = _islands(events(both, keys, start, end, ("_a", "_b")), keys, ("_a", "_b"), left(a, b), left(a - da, b - db), width)
    return found.select(*keys, F.col("pos").alias(start), F.col("_next").alias(end))


def duplicated_bases(entries: DataFrame, keys: Sequence[str], entry: str, start: str = "start", end: str = "end", width: int | None = SWEEP) -> DataFrame:
    """For each entry, its bases where two or more different entries are active.

    An entry's own intervals are merged first.  The sweep yields stretches with two or more entries; each entry is
    credited with what it covers of them.
    """
    own = merge(entries, [*keys, entry], start, end, None)
    several, before = F.col("_one") >= 2, F.col("_one") - F.col("_d__one") >= 2
    shared = _islands(events(own, keys, start, end), keys, ("_one",), several, before, width).select(*keys, F.col("pos").alias("_from"), F.col("_next").alias("_to"))
    met = overlap_join(own, shared, keys, (start, end), ("_from", "_to"))
    return met.groupBy(entry).agg(F.sum(overlap_length(F.col(start), F.col(end), F.col("_from"), F.col("_to"))).alias("n_duplicated"))
