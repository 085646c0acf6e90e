"""The spliced coordinate: exon order, cumulative length, offsets, regions and their invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinroute.operators.unions import stacked


def exon_order(exons: DataFrame) -> DataFrame:
    """Exons with exon_index and the exclusive cumulative length tx_start, in 5'-3' order of each transcript."""
    along = F.when(F.col("strand") == "-", -F.col("g_end")).otherwise(F.col("g_start"))
    order = Window.partitionBy("transcript_id").orderBy(along, "g_start", "g_end")
    size = F.col("g_end") - F.col("g_start")
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return exons.withColumn("exon_index", F.row_number().over(order) - 1).withColumn("tx_start", before).withColumn("tx_end", F.col("tx_start") + size)


def transcript_table(exons: DataFrame) -> DataFrame:
    """One row per transcript with its length, exons and strand."""
    return exons.groupBy("transcript_id").agg(F.min("gene_id").alias("gene_id"), F.min("chrom").alias("chrom"), F.min("strand").alias("strand"), F.sum(F.col("g_end") - F.col("g_start")).cast("long").alias("transcript_len"), F.count("*").alias("n_exons"))


def coverage_offset(transcripts: DataFrame) -> DataFrame:
    """transcripts with the sum of lengths before them by id.

    Lengths are summed by blocks of ids first; only one row a block is ordered as a whole.
    """
    blocks = transcripts.withColumn("_block", F.floor(F.col("transcript_id") / 4096))
    heads = blocks.groupBy("_block").agg(F.sum("transcript_len").alias("_len"))
    before = F.coalesce(F.sum("_len").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("transcript_len").over(Window.partitionBy("_block").orderBy("transcript_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return blocks.join(heads.withColumn("_before", before).drop("_len"), "_block").withColumn("coverage_offset", (F.col("_before") + inside).cast("long")).drop("_block", "_before")


def coordinate_violations(exons: DataFrame) -> DataFrame:
    """(transcript_id, problem): several chromosomes or strands, overlapping exons, empty exons."""
    order = Window.partitionBy("transcript_id").orderBy("g_start", "g_end")
    marked = exons.withColumn("_before", F.max("g_end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    found = marked.groupBy("transcript_id").agg(
        (F.count_distinct("chrom") > 1).alias("several_chromosomes"),
        (F.count_distinct("strand") > 1).alias("several_strands"),
        F.bool_or(F.coalesce(F.col("_before") > F.col("g_start"), F.lit(False))).alias("overlapping_exons"),
        F.bool_or(F.col("g_end") <= F.col("g_start")).alias("empty_exon"),
    )
    names = ("several_chromosomes", "several_strands", "overlapping_exons", "empty_exon")
    return found.select("transcript_id", F.explode(F.array_compact(F.array(*(F.when(F.col(n), F.lit(n)) for n in names)))).alias("problem"))


def spliced_violations(spliced: DataFrame, declared: DataFrame, regions: DataFrame, cds_exons: DataFrame) -> DataFrame:
    """(transcript_id, problem) of a spliced exon table against everything that has to agree with it, in one pass.

    spliced: transcript_id, chrom, strand, g_start, g_end, tx_start, tx_end.  declared: transcript_id, declared_len.  regions: transcript_id, label, start, end
    on the spliced axis.  cds_exons: transcript_id, g_start, g_end.  The four tables meet as tagged rows in one shuffle by transcript.
    Along the axis every exon has to begin where the one before ended, the first at 0, and to be as long as on the genome;
    genome starts have to run with the strand; the last end has to be the declared length; there has to be one CDS, on the axis and as long as
    its genome exons.
    """
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda df, tag, a, b, g=None, e=None, strand=None: df.select(
        "transcript_id", F.lit(tag).alias("tag"), a.cast("long").alias("a"), b.cast("long").alias("b"), (F.col(g) if g else none("long")).cast("long").alias("g"), (F.col(e) if e else none("long")).cast("long").alias("e"),
        (F.col(strand) if strand else none("string")).alias("strand"), (F.col("chrom") if strand else none("string")).alias("chrom"),
    )
    rows = stacked(
        row(spliced, "exon", F.col("tx_start"), F.col("tx_end"), "g_start", "g_end", "strand"),
        row(declared, "length", F.lit(0), F.col("declared_len")),
        row(regions.where("label = 'CDS'"), "cds", F.col("start"), F.col("end")),
        row(cds_exons, "genome", F.col("g_start"), F.col("g_end")),
    )
    order = Window.partitionBy("transcript_id", "tag").orderBy("a", "b")
    chained = rows.withColumn("_before", F.lag("b").over(order)).withColumn("_g", F.lag("g").over(order)).withColumn("_e", F.lag("e").over(order))
    exon, cds = F.col("tag") == "exon", F.col("tag") == "cds"
    back = F.col("strand") == "-"
    disordered = F.when(back, F.col("e") > F.col("_g")).otherwise(F.col("_e") > F.col("g"))
    n = lambda when: F.count_if(F.coalesce(when, F.lit(False)))
    size = lambda when: F.coalesce(F.sum(F.when(when, F.col("b") - F.col("a"))), F.lit(0))
    found = chained.groupBy("transcript_id").agg(
        n(exon).alias("exons"), n(cds).alias("cds"), n(F.col("tag") == "length").alias("lengths"),
        n(exon & (F.col("a") != F.coalesce("_before", F.lit(0)))).alias("gaps"), n(exon & (F.col("b") - F.col("a") != F.col("e") - F.col("g"))).alias("stretched"), n(exon & disordered).alias("disordered"),
        F.count_distinct("chrom").alias("chroms"), F.count_distinct("strand").alias("strands"), n(exon & ~F.col("strand").isin("+", "-")).alias("odd_strands"),
        F.max(F.when(exon, F.col("b"))).alias("len"), F.max(F.when(F.col("tag") == "length", F.col("b"))).alias("declared"), F.max(F.when(cds, F.col("b"))).alias("cds_end"), F.min(F.when(cds, F.col("a"))).alias("cds_start"),
        size(cds).alias("cds_len"), size(F.col("tag") == "genome").alias("genome_len"),
    )
    tests = {
        "unknown_transcript": F.col("exons") == 0,
        "several_chromosomes": F.col("chroms") > 1,
        "several_strands": (F.col("strands") > 1) | (F.col("odd_strands") > 0),
        "axis_not_contiguous": F.col("gaps") > 0,
        "exon_length_differs": F.col("stretched") > 0,
        "exons_out_of_order": F.col("disordered") > 0,
        "no_declared_length": F.col("lengths") == 0,
        "declared_length_differs": (F.col("exons") > 0) & (F.col("lengths") > 0) & (F.col("len") != F.col("declared")),
        "no_cds": F.col("cds") == 0,
        "several_cds": F.col("cds") > 1,
        "cds_off_the_transcript": (F.col("cds_start") < 0) | (F.col("cds_end") > F.col("len")) | (F.col("cds_start") >= F.col("cds_end")),
        "genomic_cds_length_differs": (F.col("cds") == 1) & (F.col("cds_len") != F.col("genome_len")),
    }
    return found.select("transcript_id", F.explode(F.array_compact(F.array(*(F.when(when, F.lit(name)) for name, when in tests.items())))).alias("problem"))


def normalized_regions(transcripts: DataFrame) -> DataFrame:
    """(transcript_id, label, start, end) from transcript_len, cds_start, cds_end and has_stop.

    An annotated stop codon moves from the CDS to UTR3; an absent region has no row; a transcript without CDS has none.
    """
    cut = F.when(F.col("has_stop"), F.col("cds_end") - 3).otherwise(F.col("cds_end"))
    part = lambda label, a, b: F.struct(F.lit(label).alias("label"), a.cast("long").alias("start"), b.cast("long").alias("end"))
    parts = F.array(part("UTR5", F.lit(0), F.col("cds_start")), part("CDS", F.col("cds_start"), cut), part("UTR3", cut, F.col("transcript_len")))
    rows = transcripts.where("cds_start IS NOT NULL").select("transcript_id", F.explode(F.filter(parts, lambda p: p["start"] < p["end"])).alias("p"))
    return rows.select("transcript_id", "p.label", "p.start", "p.end")


def tiling_violations(regions: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Transcripts whose regions leave a gap, overlap or do not reach both ends."""
    order = Window.partitionBy("transcript_id").orderBy("start")
    gaps = regions.withColumn("_ok", F.col("start") == F.coalesce(F.lag("end").over(order), F.lit(0)))
    ends = gaps.groupBy("transcript_id").agg(F.bool_and("_ok").alias("joined"), F.max("end").alias("last"))
    return ends.join(transcripts.select("transcript_id", "transcript_len"), "transcript_id").where("NOT joined OR last <> transcript_len").select("transcript_id", "joined", "last", "transcript_len")


def junction_bins(transcripts: DataFrame, left: int = 35, right: int = 10) -> DataFrame:
    """Five bins clipped to the transcript, empty ones left out; cds_end includes the stop codon."""
    length = F.col("transcript_len")
    edges = [F.lit(0), F.col("cds_start") - left, F.col("cds_start") + right, F.col("cds_end") - left, F.col("cds_end") + right, length]
    at = [F.greatest(F.lit(0), F.least(e, length)).cast("long") for e in edges]
    names = ("UTR5", "UTR5_junction", "CDS", "UTR3_junction", "UTR3")
    parts = F.array(*(F.struct(F.lit(n).alias("label"), a.alias("start"), b.alias("end")) for n, a, b in zip(names, at, at[1:], strict=False)))
    rows = transcripts.where("cds_start IS NOT NULL").select("transcript_id", F.explode(F.filter(parts, lambda p: p["start"] < p["end"])).alias("p"))
    return rows.select("transcript_id", "p.label", "p.start", "p.end")


def trimmed(start: Column, end: Column, trim: int) -> tuple[Column, Column]:
    """Both ends cut by ``trim``; a short slice collapses to empty and never inverts."""
    return start + trim, F.greatest(start + trim, end - trim)


def genome_axis(exons: DataFrame, transcript_id: int) -> DataFrame:
    """(tpos, gpos) of one transcript, base by base in 5'-3' order."""
    one = exon_order(exons.where(F.col("transcript_id") == transcript_id))
    bases = one.select("strand", "g_start", "g_end", F.posexplode(F.sequence("tx_start", F.col("tx_end") - 1)).alias("k", "tpos"))
    return bases.select("tpos", F.when(F.col("strand") == "-", F.col("g_end") - 1 - F.col("k")).otherwise(F.col("g_start") + F.col("k")).alias("gpos"))


def orf_catalog(cds: DataFrame, flank: int = 3) -> DataFrame:
    """Per transcript: CDS length, codons, exons, junctions, and bases within ``flank`` of a junction (union)."""
    from twinroute.operators import intervals

    ordered = exon_order(cds)
    total = ordered.groupBy("transcript_id").agg(F.max("tx_end").alias("cds_len"), F.count("*").alias("n_cds_exons"))
    near = ordered.where("tx_start > 0").select("transcript_id", F.col("tx_start").alias("j")).join(total, "transcript_id")
    spans = near.select("transcript_id", F.greatest(F.lit(0), F.col("j") - flank).alias("start"), F.least("cds_len", F.col("j") + flank).alias("end"))
    bases = intervals.merged_length(spans, ["transcript_id"], width=None).withColumnRenamed("n_bases", "n_junction_bases")
    out = total.join(bases, "transcript_id", "left")
    return out.select("transcript_id", "cds_len", F.floor(F.col("cds_len") / 3).alias("n_codons"), (F.col("cds_len") % 3 == 0).alias("whole_codons"), "n_cds_exons", (F.col("n_cds_exons") - 1).alias("n_junctions"), F.coalesce("n_junction_bases", F.lit(0)).cast("long").alias("n_junction_bases"))


def cds_start_sites(cds_exons: DataFrame) -> DataFrame:
    """(transcript_id, chrom, strand, site): the first base of the CDS along the strand."""
    site = F.when(F.min("strand") == "-", F.max("g_end") - 1).otherwise(F.min("g_start"))
    return cds_exons.groupBy("transcript_id").agg(F.min("chrom").alias("chrom"), F.min("strand").alias("strand"), site.alias("site"))
