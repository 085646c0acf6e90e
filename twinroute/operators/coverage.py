"""Placing reads on transcripts and per-base coverage, sparse throughout.

Tie rule wherever several exons or transcripts could claim a read: the least (transcript_id, g_start).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinroute.operators import intervals
from twinroute.operators.alignments import READ
from twinroute.operators.coords import exon_order
from twinroute.operators.unions import shared, stacked

#: Bin width in which points meet stretches of exons.
POINT = 16
#: Longest block that meets exons as they look from the block's bin.
NEAR = 64


def point_hits(points: DataFrame, exons: DataFrame, stranded: bool = True, width: int = intervals.BIN) -> DataFrame:
    """All exons at the reads' points (sample, read_id, chrom, strand, p5)."""
    on = ["chrom", "strand"] if stranded else ["chrom"]
    right = exons.select("transcript_id", "gene_id", *on, "g_start", "g_end", *[c for c in ("tx_start",) if c in exons.columns])
    return intervals.point_join(points, right, on, "p5", ("g_start", "g_end"), width)


def _stretches(exons: DataFrame, on: Sequence[str], width: int) -> DataFrame:
    """(on, _a, _b, _lo, _hi): exons cut at all their ends; of each stretch the hit that the tie rule takes and the one on the greatest transcript.

    Made of the annotation alone; equal exons count once.
    """
    spans = exons.where("g_start < g_end").groupBy(*on, "g_start", "g_end").agg(F.min(F.struct("transcript_id", "gene_id")).alias("lo"), F.max(F.struct("transcript_id", "gene_id")).alias("hi"))
    cuts = spans.select(*on, F.explode(F.array(F.col("g_start").cast("long"), F.col("g_end").cast("long"))).alias("pos")).distinct()
    parts = intervals.sweep(cuts, on).select(*on, F.col("pos").alias("_a"), F.col("_next").alias("_b")).where("_b IS NOT NULL")
    met = intervals.overlap_join(parts, spans, on, ("_a", "_b"), ("g_start", "g_end"), width)
    row = lambda c: F.struct(F.col(f"{c}.transcript_id").alias("transcript_id"), "g_start", F.col(f"{c}.gene_id").alias("gene_id"), "g_end")
    return met.groupBy(*on, "_a", "_b").agg(F.min(row("lo")).alias("_lo"), F.max(row("hi")).alias("_hi"))


def _at_points(points: DataFrame, stretches: DataFrame, on: Sequence[str]) -> DataFrame:
    """points in their stretch, at most one.  The points are read once and in narrow bins, where few stretches meet."""
    return intervals.point_join(points, stretches, on, "p5", ("_a", "_b"), POINT)


def end_hits(points: DataFrame, exons: DataFrame, stranded: bool = True, width: int = intervals.BIN) -> DataFrame:
    """Of each point's hits the one that the tie rule takes and one on the greatest transcript, if that is another: two rows at most.

    Enough for first hits and for whether there are several transcripts, and it does not grow with how many exons lie at a
    point.
    """
    on = ["chrom", "strand"] if stranded else ["chrom"]
    ends = F.when(F.col("_lo.transcript_id") == F.col("_hi.transcript_id"), F.array("_lo")).otherwise(F.array("_lo", "_hi"))
    at = _stretches(exons, on, width).select(*on, "_a", "_b", ends.alias("_ends"))
    return _at_points(points, at, on).withColumn("_hit", F.explode("_ends")).select(*points.columns, "_hit.*")


def first_hits(points: DataFrame, exons: DataFrame, stranded: bool = True, width: int = intervals.BIN) -> DataFrame:
    """``first_hit`` of ``point_hits``, a row a read, from the stretch at the point."""
    on = ["chrom", "strand"] if stranded else ["chrom"]
    at = _stretches(exons, on, width).drop("_hi")
    return first_hit(_at_points(points, at, on).select(*points.columns, "_lo.*"))


def first_hit(hits: DataFrame) -> DataFrame:
    """One hit per read by the tie rule."""
    names = [c for c in hits.columns if c not in (*READ, "transcript_id", "g_start")]
    best = F.min(F.struct("transcript_id", "g_start", *names)).alias("best")
    return hits.groupBy(*READ).agg(best).select(*READ, "best.*")


def two_stage(points: DataFrame, first: DataFrame, second: DataFrame, width: int = intervals.BIN) -> DataFrame:
    """First hits on ``first`` (CDS exons); only reads without one try ``second`` (all exons).  ``stage`` says which."""
    on = ["chrom", "strand"]
    at = lambda exons, n: _stretches(exons, on, width).drop("_hi").withColumn("stage", F.lit(n))
    # a point is in one stretch of each stage; the lesser stage goes before all else
    met = _at_points(points, stacked(at(first, 1), at(second, 2)), on).select(*points.columns, "_lo.*", "stage")
    names = [c for c in met.columns if c not in (*READ, "stage", "transcript_id", "g_start")]
    best = F.min(F.struct("stage", "transcript_id", "g_start", *names)).alias("best")
    return met.groupBy(*READ).agg(best).select(*READ, "best.transcript_id", "best.g_start", *(f"best.{c}" for c in names), "best.stage")


def overlap_sums(blocks: DataFrame, exons: DataFrame, width: int = intervals.BIN) -> DataFrame:
    """(sample, read_id, transcript_id, n_overlap): summed overlap of the read's blocks (pos, epos) on its strand."""
    right = exons.select("transcript_id", "chrom", "strand", "g_start", "g_end")
    hit = intervals.overlap_join(blocks, right, ["chrom", "strand"], ("pos", "epos"), ("g_start", "g_end"), width)
    size = intervals.overlap_length(F.col("pos"), F.col("epos"), F.col("g_start"), F.col("g_end"))
    return hit.groupBy(*READ, "transcript_id").agg(F.sum(size).alias("n_overlap"))


def max_overlap(sums: DataFrame) -> DataFrame:
    """The transcript of most overlap for each read; ties go to the least id."""
    best = F.max(F.struct("n_overlap", (-F.col("transcript_id")).alias("least"))).alias("b")
    return sums.groupBy(*READ).agg(best).select(*READ, (-F.col("b.least")).alias("transcript_id"), F.col("b.n_overlap").alias("n_overlap"))


def best_overlap(blocks: DataFrame, exons: DataFrame, width: int = intervals.BIN) -> DataFrame:
    """sample, read_id, transcript_id (most overlap, ties to the least id), n_overlap, n_transcripts at the read and n_tied of them at the top.

    As ``overlap_sums`` and ``max_overlap``, but one read of each kind (equal blocks) meets one transcript of each chain (equal
    exons), so the rows do not grow with how many of either are alike.  The blocks of a read and the exons of a transcript are few.
    A read of one short block meets transcripts by what they have near it (``_near_best``); reads of several blocks or a long one meet chains.
    """
    on = ["chrom", "strand"]
    listed = lambda df, key, *span: df.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*on, *span))).alias("_all"))
    of_read = listed(blocks, READ, "pos", "epos")
    # the list itself is the kind's name
    kinds = shared(of_read.groupBy("_all").agg(F.max(F.size("_all")).alias("_k")), "_k").withColumn("_b", F.explode("_all")).select("_all", "_k", "_b.*")
    near = (F.col("_k") == 1) & F.coalesce(F.col("epos") - F.col("pos") <= NEAR, F.lit(False))
    chains = listed(exons, ["transcript_id"], "g_start", "g_end").groupBy("_all").agg(F.min("transcript_id").alias("transcript_id"), F.count("*").alias("_m"))
    right = chains.select("transcript_id", "_m", F.explode("_all").alias("_x")).select("transcript_id", "_m", "_x.*")
    hit = intervals.overlap_join(kinds.where(~near).drop("_k"), right, on, ("pos", "epos"), ("g_start", "g_end"), width)
    size = intervals.overlap_length(F.col("pos"), F.col("epos"), F.col("g_start"), F.col("g_end"))
    summed = hit.groupBy("_all", "transcript_id", "_m").agg(F.sum(size).alias("n_overlap"))
    top = stacked(_top(summed, ["_all"]), _near_best(kinds.where(near).drop("_all", "_k"), chains))
    return of_read.join(top, "_all").select(*READ, "b.transcript_id", "b.n_overlap", "n_transcripts", "b.n_tied")


def _top(summed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, b, n_transcripts): the transcript of most overlap, how many tie with it, and all of them."""
    by_size = summed.groupBy(*keys, "n_overlap").agg(F.min("transcript_id").alias("transcript_id"), F.sum("_m").alias("n_tied"))
    return by_size.groupBy(*keys).agg(F.max(F.struct("n_overlap", "transcript_id", "n_tied")).alias("b"), F.sum("n_tied").alias("n_transcripts"))


def _near_best(blocks: DataFrame, chains: DataFrame) -> DataFrame:
    """``_top`` of distinct blocks (chrom, strand, pos, epos) of up to ``NEAR`` bases, named by their list ``_all``.

    From a bin of ``POINT`` bases such blocks see no further than ``POINT + NEAR - 1``.  Transcripts that look alike from there, with exons cut to that
    window, are one; a block meets the looks of its bin, in which all its overlaps are told, so nothing is shuffled after they met.
    """
    x0, reach = F.col("_bin") * POINT, POINT + NEAR - 1
    real = F.filter("_all", lambda x: x["g_start"] < x["g_end"])
    bins = F.transform(real, lambda x: F.transform(F.sequence(F.floor((x["g_start"] - reach) / POINT) + 1, F.floor((x["g_end"] - 1) / POINT)), lambda b: F.struct(x["chrom"].alias("chrom"), x["strand"].alias("strand"), b.alias("_bin"))))
    at = chains.select("transcript_id", "_m", real.alias("_all"), F.explode(F.array_distinct(F.flatten(bins))).alias("_w")).select("transcript_id", "_m", "_all", "_w.*")
    seen = F.filter("_all", lambda x: (x["chrom"] == F.col("chrom")) & (x["strand"] == F.col("strand")) & (x["g_start"] < x0 + reach) & (x0 < x["g_end"]))
    cut = F.transform(seen, lambda x: F.struct(F.greatest(x["g_start"].cast("long"), x0).alias("s"), F.least(x["g_end"].cast("long"), x0 + reach).alias("e")))
    on = ["chrom", "strand", "_bin"]
    looks = at.groupBy(*on, cut.alias("_look")).agg(F.min("transcript_id").alias("transcript_id"), F.sum("_m").alias("_m"))
    over = F.aggregate("_look", F.lit(0).cast("long"), lambda n, x: n + F.greatest(F.lit(0), F.least(F.col("epos"), x["e"]) - F.greatest(F.col("pos"), x["s"])).cast("long"))
    met = blocks.where("pos < epos").withColumn("_bin", F.floor(F.col("pos") / POINT)).join(looks, on).select(*on, "pos", "epos", "transcript_id", "_m", over.alias("n_overlap")).where("n_overlap > 0")
    return _top(met, [*on, "pos", "epos"]).select(F.array(F.struct("chrom", "strand", "pos", "epos")).alias("_all"), "b", "n_transcripts")


def exposure(hits: DataFrame, best: DataFrame) -> DataFrame:
    """How many reads the tie rules decide: point candidates (``end_hits`` or all) and tied overlaps (``best_overlap``) by sample."""
    per = hits.groupBy(*READ).agg((F.min("transcript_id") != F.max("transcript_id")).alias("many")).groupBy("sample").agg(F.count("*").alias("n_point"), F.count_if("many").alias("n_point_ambiguous"))
    over = best.groupBy("sample").agg(F.count("*").alias("n_overlap"), F.count_if(F.col("n_transcripts") > 1).alias("n_overlap_ambiguous"), F.count_if(F.col("n_tied") > 1).alias("n_overlap_tied"))
    both = per.join(over, "sample", "full_outer").fillna(0)
    return both.withColumn("pct_point_ambiguous", F.when(F.col("n_point") > 0, F.lit(100.0) * F.col("n_point_ambiguous") / F.col("n_point"))).withColumn(
        "pct_overlap_tied", F.when(F.col("n_overlap") > 0, F.lit(100.0) * F.col("n_overlap_tied") / F.col("n_overlap"))
    )


def transcript_overlaps(blocks: DataFrame, exons: DataFrame, width: int | None = intervals.SWEEP) -> DataFrame:
    """(sample, transcript_id, n_pairs, n_bases): pairs of overlapping blocks and exons and their summed overlap, no pair formed.

    Up to a position x of a (sample, chromosome, strand) so many blocks began and ended, and cover so many bases; an exon's pairs are
    the blocks begun before its end less those ended by its start, its bases the difference of covered bases.  Ends of exons
    are events without weight in the same sweep.
    """
    on, values = ["chrom", "strand"], ("_s", "_e", "_w")
    keys = ["sample", *on]
    sides = F.array(*(F.struct(F.col(c).cast("long").alias("pos"), F.lit(s).alias("_s"), F.lit(e).alias("_e"), (F.col(c) * (e - s)).cast("long").alias("_w")) for c, s, e in (("pos", 1, 0), ("epos", 0, 1))))
    moved = blocks.where("pos < epos").select(*keys, F.explode(sides).alias("_v")).groupBy(*keys, "_v.pos").agg(*(F.sum(f"_v.{v}").alias(v) for v in values))
    real = exons.where("g_start < g_end")
    edges = real.select(*on, F.explode(F.array(F.col("g_start").cast("long"), F.col("g_end").cast("long"))).alias("pos")).distinct()
    asked = blocks.select("sample").distinct().join(edges).select(*keys, "pos", *(F.lit(0).cast("long").alias(v) for v in values))
    changes = stacked(moved, asked).groupBy(*keys, "pos").agg(*(F.sum(v).alias(v) for v in values))
    ran = intervals.sweep(changes, keys, values, width).select(*keys, "pos", "_s", (F.col("_s") - F.col("_d__s")).alias("_before"), "_e", (F.col("_w") + F.col("pos") * (F.col("_s") - F.col("_e"))).alias("_c"))
    spans = real.select(*on, F.col("g_start").cast("long").alias("g_start"), F.col("g_end").cast("long").alias("g_end")).distinct()
    first = ran.select(*keys, F.col("pos").alias("g_start"), F.col("_e").alias("_ended"), F.col("_c").alias("_c0"))
    last = ran.select(*keys, F.col("pos").alias("g_end"), F.col("_before").alias("_begun"), F.col("_c").alias("_c1"))
    pairs = F.col("_begun") - F.col("_ended")
    counted = spans.join(first, [*on, "g_start"]).join(last, [*keys, "g_end"]).select(*keys, "g_start", "g_end", pairs.alias("_n"), (F.col("_c1") - F.col("_c0")).alias("_b")).where("_n > 0")
    own = real.groupBy(*on, F.col("g_start").cast("long").alias("g_start"), F.col("g_end").cast("long").alias("g_end"), "transcript_id").agg(F.count("*").alias("_k"))
    met = own.join(counted, [*on, "g_start", "g_end"])
    return met.groupBy("sample", "transcript_id").agg(F.sum(F.col("_n") * F.col("_k")).alias("n_pairs"), F.sum(F.col("_b") * F.col("_k")).alias("n_bases"))


def to_transcript(hits: DataFrame, exons: DataFrame) -> DataFrame:
    """First hits with ``tpos``, the spliced position of p5."""
    known = exon_order(exons).select("transcript_id", "g_start", "g_end", F.col("strand").alias("x_strand"), "tx_start")
    at = F.when(F.col("x_strand") == "-", F.col("g_end") - 1 - F.col("p5")).otherwise(F.col("p5") - F.col("g_start"))
    return hits.drop("g_end", "tx_start").join(known, ["transcript_id", "g_start"]).withColumn("tpos", F.col("tx_start") + at).drop("x_strand")


def point_coverage(points: DataFrame, keys: list[str], position: str) -> DataFrame:
    return points.where(F.col(position).isNotNull()).groupBy(*keys, F.col(position).alias("pos")).agg(F.count("*").alias("n"))


def window_sums(points: DataFrame, regions: DataFrame, width: int = intervals.BIN) -> DataFrame:
    """Sums of sparse points (transcript_id, pos, n) in regions (transcript_id, label, start, end) per sample."""
    met = intervals.point_join(points, regions, ["transcript_id"], "pos", ("start", "end"), width)
    return met.groupBy("sample", "transcript_id", "label").agg(F.sum("n").alias("n"))


def as_segments(points: DataFrame, count: str = "n") -> DataFrame:
    """Points (pos, n) as segments (start, end, depth) of one base."""
    return points.withColumn("start", F.col("pos")).withColumn("end", F.col("pos") + 1).withColumn("depth", F.col(count)).drop("pos", count)


def slice_sums(segments: DataFrame, slices: DataFrame, keys: Sequence[str] = ("sample",)) -> DataFrame:
    """(keys, transcript_id, label, total): sums of run-length segments over any slice (transcript_id, label, start, end), no base expanded.

    A slice's sum is the difference of two prefix sums.  Both ends are looked up as of their position: they are laid between
    the segments of their (keys, transcript), where the running sum less what the last segment has beyond the position is
    the prefix.  A slice whose start lies behind its end gives the difference as it is, zero or less.
    """
    own = [*keys, "transcript_id"]
    ran = segments.select(*own, F.col("start").alias("pos"), F.lit(0).alias("_k"), F.col("end").alias("_end"), "depth", (F.col("depth") * (F.col("end") - F.col("start"))).alias("_sum"))
    ends = F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col("start").alias("pos")), F.struct(F.lit(1).alias("sign"), F.col("end").alias("pos")))).alias("b")
    asked = segments.select(*own).distinct().join(slices.select("transcript_id", "label", ends), "transcript_id").select(*own, "b.pos", F.lit(1).alias("_k"), "label", "b.sign")
    # a segment that starts at the position adds nothing yet: it comes after
    order = Window.partitionBy(*own).orderBy("pos", F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(order)
    both = stacked(ran, asked, missing=True)
    prefix = F.coalesce(F.sum("_sum").over(order), F.lit(0)) - F.coalesce(last("depth") * F.greatest(F.lit(0), last("_end") - F.col("pos")), F.lit(0))
    found = both.withColumn("_prefix", prefix).where("_k = 1")
    return found.groupBy(*own, "label").agg(F.sum(F.col("sign") * F.col("_prefix")).cast("long").alias("total"))


def coverage_key(genome: DataFrame, txome: DataFrame, transcripts: DataFrame, trim: int, trimmed: bool) -> DataFrame:
    """Which (sample, transcript) with a read on either route count as covered.

    genome, txome: segments.  Each transcript is summed over its own bounds: the whole CDS (P-sites) or, ``trimmed``, the CDS without ``trim``
    bases at both ends (footprints).  Eligible are those whose trimmed CDS is not empty; a transcript without CDS is not.
    """
    cut = F.lit(trim if trimmed else 0)
    start, end = (F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("cds_start", "cds_end"))
    slices = transcripts.select("transcript_id", F.lit("CDS").alias("label"), (start + cut).alias("start"), (end - cut).alias("end"))
    sides = stacked(genome.withColumn("route", F.lit("genome")), txome.withColumn("route", F.lit("txome")))
    sums = slice_sums(sides, slices, ["route", "sample"]).groupBy("sample", "transcript_id").agg(
        *((F.coalesce(F.max(F.when(F.col("route") == r, F.col("total"))), F.lit(0)) > 0).alias(f"key_{r}") for r in ("genome", "txome"))
    )
    bounds = transcripts.select("transcript_id", (end - start - 2 * trim).alias("interior"))
    out = sums.join(bounds, "transcript_id").withColumn("eligible", F.col("interior") > 0)
    return out.select("sample", "transcript_id", "interior", "eligible", "key_genome", "key_txome", (F.col("eligible") & (F.col("key_genome") | F.col("key_txome"))).alias("covered"))
