"""Read-length and reading-frame quality control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinroute.functions.columns import text_bool
from twinroute.operators import intervals

KEY = ["sample", "qlen"]


def length_histogram(reads: DataFrame) -> DataFrame:
    counted = reads.groupBy(*KEY).agg(F.count("*").alias("n_reads"))
    total = F.sum("n_reads").over(Window.partitionBy("sample"))
    return counted.withColumn("pct_reads", F.lit(100.0) * F.col("n_reads") / total)


def length_window(histogram: DataFrame, least: int = 21, most: int = 40, capture: float = 0.85) -> DataFrame:
    """(sample, lo, hi, captured, total): the window grown from the peak until it holds more than ``capture``.

    The larger neighbour joins, the upper one on ties; the shortest of equal peaks starts.  The counts of a library
    are at most ``most`` numbers, held in one array; samples without a read in range have no row.
    """
    size = most - least + 1
    cell = [F.coalesce(F.sum(F.when(F.col("qlen") == n, F.col("n_reads"))), F.lit(0)).cast("long") for n in range(least, most + 1)]
    arrays = histogram.groupBy("sample").agg(F.array(*cell).alias("c"))
    arrays = arrays.withColumn("total", F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x)).where("total > 0")
    peak = F.array_position("c", F.array_max("c")).cast("int")
    at = lambda i: F.element_at(F.col("c"), i)
    begin = F.struct(peak.alias("lo"), peak.alias("hi"), F.array_max("c").alias("captured"))

    def step(s: Column, _: Column) -> Column:
        lo, hi = s["lo"], s["hi"]
        done = (s["captured"] > F.col("total") * F.lit(capture)) | ((lo == 1) & (hi == size))
        up = F.when(hi == size, F.lit(False)).when(lo == 1, F.lit(True)).otherwise(at(F.least(hi + 1, F.lit(size))) >= at(F.greatest(lo - 1, F.lit(1))))
        new_hi, new_lo = hi + F.when(~done & up, 1).otherwise(0), lo - F.when(~done & ~up, 1).otherwise(0)
        more = F.when(done, F.lit(0)).when(up, at(F.least(hi + 1, F.lit(size)))).otherwise(at(F.greatest(lo - 1, F.lit(1))))
        return F.struct(new_lo.alias("lo"), new_hi.alias("hi"), (s["captured"] + more).alias("captured"))

    grown = arrays.withColumn("s", F.aggregate(F.sequence(F.lit(1), F.lit(size)), begin, step))
    return grown.select("sample", (F.col("s.lo") + least - 1).alias("lo"), (F.col("s.hi") + least - 1).alias("hi"), F.col("s.captured").alias("captured"), "total")


def metagene(reads: DataFrame, up: int = 50, down: int = 30) -> DataFrame:
    """(sample, qlen, rel, n) for rel in [-up, down), zero-filled over the small grid of lengths and positions."""
    counted = reads.where((F.col("rel") >= -up) & (F.col("rel") < down)).groupBy(*KEY, "rel").agg(F.count("*").alias("n"))
    grid = reads.select(*KEY).distinct().withColumn("rel", F.explode(F.sequence(F.lit(-up), F.lit(down - 1))))
    counted = counted.withColumn("rel", F.col("rel").cast("int"))
    return grid.join(counted, [*KEY, "rel"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def psite_offsets(grid: DataFrame, default: int = 12, flank: int = 6, codons: int = 10, least: int = 200, dominant: float = 0.40) -> DataFrame:
    """(sample, qlen, offset) from a metagene grid (sample, qlen, rel, n).

    The frame is the downstream residue that dominates, or with little or unphased signal that of the
    upstream peak (ties: the lowest).  The offset is the first position of that frame in the scan range over a
    threshold one sixth of the way from the upstream to the downstream maximum.
    """
    n, rel = F.col("n"), F.col("rel")
    mod = F.pmod(rel, F.lit(3))
    up = rel < 0
    mass = [F.coalesce(F.sum(F.when((rel >= 0) & (rel < 3 * codons) & (mod == r), n)), F.lit(0)).alias(f"m{r}") for r in range(3)]
    peak = F.max(F.when(up, F.struct(n.alias("n"), (-rel).alias("k")))).alias("peak")
    edge = -default - flank
    per = []
    for r in range(3):
        here = mod == r
        per += [F.max(F.when(here & (rel <= edge), n)).alias(f"a{r}"), F.max(F.when(here & (rel >= edge), n)).alias(f"b{r}")]
    base = grid.groupBy(*KEY).agg(*mass, peak, *per)
    m = [F.col(f"m{r}") for r in range(3)]
    total, top = m[0] + m[1] + m[2], F.greatest(*m)
    by_mass = F.when(m[0] == top, 0).when(m[1] == top, 1).otherwise(2)
    by_peak = F.pmod(-F.col("peak.k"), F.lit(3)).cast("int")
    base = base.withColumn("frame", F.when((total < least) | (top / total < dominant), by_peak).otherwise(by_mass))
    pick = lambda c: F.when(F.col("frame") == 0, F.col(f"{c}0")).when(F.col("frame") == 1, F.col(f"{c}1")).otherwise(F.col(f"{c}2"))
    base = base.withColumn("limit", pick("a") + ((pick("b") - pick("a")) / 6.0).cast("int"))
    scan = grid.join(base.select(*KEY, "frame", "limit", "peak"), KEY)
    ok = (rel > edge) & (rel < -default + flank) & (mod == F.col("frame")) & (n > F.col("limit"))
    found = scan.groupBy(*KEY).agg(F.min(F.when(ok, rel)).alias("at"), F.max("peak.n").alias("top"))
    return found.select(*KEY, F.when(F.coalesce("top", F.lit(0)) == 0, default).otherwise(F.coalesce(-F.col("at"), F.lit(default))).cast("int").alias("offset"))


def assigned_inside(points: DataFrame, position: str, total: Column) -> DataFrame:
    """Points whose position lies on the CDS, [0, total)."""
    return points.where((F.col(position) >= 0) & (F.col(position) < total))


def frame_counts(points: DataFrame, position: str) -> DataFrame:
    """Counts and shares of the three frames of ``position`` (relative to the CDS) by library and length."""
    frame = F.pmod(F.col(position), F.lit(3))
    counted = points.groupBy(*KEY).agg(F.count("*").alias("n"), *(F.count_if(frame == r).alias(f"n_frame{r}") for r in range(3)))
    return counted.select("*", *((F.lit(100.0) * F.col(f"n_frame{r}") / F.col("n")).alias(f"pct_frame{r}") for r in range(3)))


def periodicity(frames: DataFrame, least: float = 50.0) -> DataFrame:
    """Frame shares rounded half-even to one place before the test against the limit."""
    out = frames
    for r in range(3):
        out = out.withColumn(f"frame{r}_pct", F.bround(F.col(f"pct_frame{r}"), 1))
    return out.withColumn("periodic", F.col("frame0_pct") >= least)


def selected_lengths(master: DataFrame, asked: DataFrame) -> DataFrame:
    """(sample, read_length, psite_offset) that a QC master selects (``in_phase1``, as text or boolean) for the samples asked for.

    All samples that the master lacks, or for which it selects nothing, are refused at once: the query fails with their names.
    """
    from twinroute.operators.checks import refused, require_columns

    known = require_columns(master, ["sample", "read_length", "in_phase1", "psite_offset"], "QC master")
    wanted = known.where(text_bool(F.col("in_phase1"))).join(asked.select("sample").distinct(), "sample", "left_semi")
    state = asked.select("sample").distinct().join(known.groupBy("sample").agg(F.count_if(text_bool(F.col("in_phase1"))).alias("n")), "sample", "left")
    bad = state.where(F.coalesce("n", F.lit(0)) == 0).select(F.concat("sample", F.when(F.col("n").isNull(), " is absent").otherwise(" has no selected length")).alias("fault"))
    return refused(wanted.select("sample", F.col("read_length").cast("int").alias("read_length"), F.col("psite_offset").cast("int").alias("psite_offset")), bad, "fault", "samples without read lengths")


def paired_selection(genome: DataFrame, txome: DataFrame) -> DataFrame:
    """Selected cells of both routes side by side with status agree, differ or one-sided."""
    g, t = (x.select("sample", "read_length", F.col("psite_offset").alias(c)) for x, c in ((genome, "g_offset"), (txome, "t_offset")))
    both = g.withColumn("g", F.lit(True)).join(t.withColumn("t", F.lit(True)), ["sample", "read_length"], "full_outer")
    status = F.when(F.col("t").isNull(), "genome_only").when(F.col("g").isNull(), "txome_only").when(F.col("g_offset").eqNullSafe(F.col("t_offset")), "agree").otherwise("differ")
    return both.select("sample", "read_length", "g_offset", "t_offset", status.alias("status"))


def frame_difference(genome: DataFrame, txome: DataFrame, column: str = "pct_frame0") -> DataFrame:
    """Median, mean and largest absolute difference of the frame-0 share over common cells, and where it is largest."""
    d = genome.select(*KEY, F.col(column).alias("g")).join(txome.select(*KEY, F.col(column).alias("t")), KEY).withColumn("d", F.col("t") - F.col("g"))
    at = F.max_by(F.struct("sample", "qlen"), F.struct(F.abs("d"), "sample", "qlen"))
    return d.agg(F.median("d").alias("median"), F.avg(F.abs("d")).alias("mean_abs"), F.max(F.abs("d")).alias("max_abs"), at["sample"].alias("at_sample"), at["qlen"].alias("at_qlen"))


def start_distances(points: DataFrame, sites: DataFrame, up: int = 50, down: int = 30, width: int = 256) -> DataFrame:
    """points (sample, read_id, qlen, chrom, strand, p5) with ``rel``, the signed distance to a start site in [-up, down).

    A read near several starts counts for the least (transcript_id, site).
    """
    window = sites.select(
        "transcript_id", "chrom", "strand", "site",
        F.when(F.col("strand") == "-", F.col("site") - down + 1).otherwise(F.col("site") - up).alias("w_start"),
        F.when(F.col("strand") == "-", F.col("site") + up + 1).otherwise(F.col("site") + down).alias("w_end"),
    )
    met = intervals.point_join(points, window, ["chrom", "strand"], "p5", ("w_start", "w_end"), width)
    first = met.groupBy("sample", "read_id", "qlen", "strand", "p5").agg(F.min(F.struct("transcript_id", "site")).alias("hit"))
    rel = F.when(F.col("strand") == "-", F.col("hit.site") - F.col("p5")).otherwise(F.col("p5") - F.col("hit.site"))
    return first.select("sample", "read_id", "qlen", "hit.transcript_id", rel.cast("int").alias("rel"))


def core_lengths(reads: DataFrame, transcripts: DataFrame, left: int = 15, right: int = 10) -> DataFrame:
    """Length histogram of transcript reads whose 5' end lies in the CDS core [cds_start + left, cds_end - right)."""
    cores = transcripts.where("cds_start IS NOT NULL").select("transcript_id", (F.col("cds_start") + left).alias("_lo"), (F.col("cds_end") - right).alias("_hi"))
    return length_histogram(reads.join(cores, "transcript_id").where("_lo <= pos AND pos < _hi"))


def reads_in_cores(points: DataFrame, cds_exons: DataFrame, width: int = 256) -> DataFrame:
    """Points (sample, read_id, qlen, chrom, strand, p5) in the union of the CDS intervals, once each."""
    spans = intervals.merge(cds_exons.select("chrom", "strand", F.col("g_start").alias("start"), F.col("g_end").alias("end")), ["chrom", "strand"])
    return intervals.point_join(points, spans, ["chrom", "strand"], "p5", ("start", "end"), width).select(*points.columns)


def first_codons(points: DataFrame, codons: int = 10, least: float = 50.0) -> DataFrame:
    """Frame shares of shifted positions ``rel`` in the first codons, rounded half-even before the test."""
    return periodicity(frame_counts(points.where((F.col("rel") >= 0) & (F.col("rel") < 3 * codons)), "rel"), least)
