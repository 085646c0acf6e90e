"""Alignment-level operators: presence, tied-best placements, read state.

Alignments have sample, read_id, chrom, pos, epos (half-open), strand, qlen, score, nh, is_secondary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinroute.functions.columns import SUPPLEMENTARY, UNMAPPED, five_prime, flag_set, in_window, is_primary, qualifies
from twinroute.operators.unions import stacked

READ = ["sample", "read_id"]


def whole(aln: DataFrame) -> DataFrame:
    """aln without unmapped and supplementary records, where it still carries flags."""
    return aln.where(~flag_set(F.col("flag"), UNMAPPED | SUPPLEMENTARY)) if "flag" in aln.columns else aln


def genome_reads(aln: DataFrame) -> DataFrame:
    """One row per read with a primary: ``genome`` is unique or multi.  Of repeated primaries the least NH counts; one without NH is an error."""
    absent = F.raise_error(F.lit("primary alignment without NH")).cast("string")
    kind = F.when(F.count_if(F.col("nh").isNull()) > 0, absent).when(F.min("nh") == 1, "unique").otherwise("multi")
    return whole(aln).where("NOT is_secondary").groupBy(*READ).agg(kind.alias("genome"))


def present_reads(aln_t: DataFrame) -> DataFrame:
    """Reads with any primary on the transcriptome route; no mapping-quality test."""
    primaries = aln_t.where(is_primary(F.col("flag"))) if "flag" in aln_t.columns else aln_t
    return primaries.select(*READ).distinct()


def tied_best(aln: DataFrame) -> DataFrame:
    """Every placement with primary_score and ``qualifies``.

    The primary may lie anywhere, so this must come before any region filter.
    """
    best = F.max(F.when(~F.col("is_secondary"), F.col("score"))).over(Window.partitionBy(*READ))
    primary = F.max((~F.col("is_secondary")).cast("int")).over(Window.partitionBy(*READ)) == 1
    out = whole(aln).withColumn("primary_score", best).withColumn("has_primary", primary)
    return out.withColumn("qualifies", F.col("has_primary") & qualifies(F.col("is_secondary"), F.col("score"), F.col("primary_score")))


def placement_audit(aln: DataFrame) -> DataFrame:
    """Per sample, the secondaries by what became of them, and reads that only a tied secondary brings here."""
    sec = F.col("is_secondary")
    n = lambda when: F.count_if(when)
    return tied_best(aln).groupBy("sample").agg(
        n(~sec).alias("n_primary"),
        n(sec & F.col("qualifies")).alias("n_secondary_tied"),
        n(sec & F.col("has_primary") & (F.col("score") < F.col("primary_score"))).alias("n_secondary_lower"),
        n(sec & F.col("has_primary") & (F.col("score") > F.col("primary_score"))).alias("n_secondary_higher"),
        n(sec & F.col("has_primary") & (F.col("score").isNull() | F.col("primary_score").isNull())).alias("n_missing_score"),
        n(sec & ~F.col("has_primary")).alias("n_no_primary"),
    )


def region_scan(aln: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Placements overlapping a region on either strand; the comparisons reach the file scan."""
    return aln.where(F.col("chrom") == chrom).where(in_window(F.col("pos"), F.col("epos"), F.lit(start), F.lit(end)))


def with_five_prime(aln: DataFrame, name: str = "p5") -> DataFrame:
    return aln.withColumn(name, five_prime(F.col("pos"), F.col("epos"), F.col("strand")))


def read_state(aln: DataFrame) -> DataFrame:
    """One row per read: its primary as a struct, NH, and all placements; the placements of a read are few."""
    place = F.struct("chrom", "pos", "epos", "strand", "score", "is_secondary")
    primary = F.min(F.when(~F.col("is_secondary"), place))
    return aln.groupBy(*READ).agg(primary.alias("primary"), F.max(F.when(~F.col("is_secondary"), F.col("nh"))).alias("nh"), F.sort_array(F.collect_list(place)).alias("placements"))


def with_blocks(aln: DataFrame) -> DataFrame:
    """Placements with ``blocks``; without a CIGAR the placement is one block."""
    if "blocks" in aln.columns:
        return aln
    return aln.withColumn("blocks", F.array(F.struct(F.col("pos").alias("start"), F.col("epos").alias("end"))))


def tagged_reads(aln_g: DataFrame, aln_t: DataFrame) -> DataFrame:
    """Qualifying placements of both routes with what their read is: ``genome`` (unique, multi or null), ``present`` and the placement's number.

    One shuffle by read: ties, places, NH and presence are windows over the same rows.  On the transcriptome route (1) the
    ``key`` is the transcript and the place its first base, so that one join meets both routes.
    """
    aln_g = whole(aln_g)
    none = lambda kind: F.lit(None).cast(kind)
    own = ["blocks"] if "blocks" in aln_g.columns else []
    spans = aln_g.select(*READ, F.lit(0).alias("route"), F.col("chrom").cast("string").alias("key"), "pos", "epos", "strand", "score", "nh", "is_secondary", *own)
    kinds = {f.name: f.dataType for f in spans.schema.fields}
    one = {"route": F.lit(1), "key": (F.col("transcript_id") if "transcript_id" in aln_t.columns else none("string")).cast("string"), "pos": F.lit(0), "epos": F.lit(1), "is_secondary": F.lit(False)}
    other = aln_t.select(*READ, *(one.get(c, none(kinds[c])).cast(kinds[c]).alias(c) for c in spans.columns[2:]))
    read = Window.partitionBy(*READ)
    primary = (F.col("route") == 0) & ~F.col("is_secondary")
    best, least, missing = (f.over(read) for f in (F.max(F.when(primary, F.col("score"))), F.min(F.when(primary, F.col("nh"))), F.count_if(primary & F.col("nh").isNull())))
    has = F.max(primary.cast("int")).over(read) == 1
    genome = F.when(missing > 0, F.raise_error(F.lit("primary alignment without NH")).cast("string")).when(has & (least == 1), "unique").when(has, "multi")
    order = read.orderBy("route", "is_secondary", "key", "pos", "epos", "strand", "score")
    seen = stacked(spans, other).select("*", F.row_number().over(order).alias("place"), genome.alias("genome"), (F.max("route").over(read) == 1).alias("present"), best.alias("best"), has.alias("has"))
    top = (F.col("route") == 1) | (F.col("has") & qualifies(F.col("is_secondary"), F.col("score"), F.col("best")))
    return with_blocks(with_five_prime(seen.where(top).drop("best", "has", "nh")))


def read_kinds(placements: DataFrame) -> DataFrame:
    """One read of each kind, all its placements, with ``n``, how many reads of the sample are of the kind.

    placements: as ``tagged_reads`` gives them.  Reads of a kind have the same placements on both routes, so whatever is told from
    these is the same for all; the read of the least id stands for them.  A read's placements are few.
    """
    rest = [*READ, "place", "genome", "present"]
    own = [c for c in placements.columns if c not in (*rest, "score")]
    per = placements.groupBy(*READ).agg(F.sort_array(F.collect_list(F.struct(*own))).alias("_rows"), F.max("genome").alias("genome"), F.max("present").alias("present"))
    kinds = per.groupBy("sample", "_rows", "genome", "present").agg(F.min("read_id").alias("read_id"), F.count("*").alias("n"))
    return kinds.select(*READ, "n", "genome", "present", F.posexplode("_rows").alias("place", "_row")).select(*READ, "n", "genome", "present", (F.col("place") + 1).alias("place"), "_row.*")


def listed_reads(aln_g: DataFrame, aln_t: DataFrame) -> DataFrame:
    """A row a read of either route: ``_g``, its qualifying placements in order, ``_t``, its transcripts (null: not on that route), and ``genome``.

    The join goes by read_id, with the sample compared beside it, so that alignments that are dealt by read_id already stay where they
    are and only the other route moves.
    """
    aln_g = whole(aln_g)
    place = place_columns(aln_g)
    primary = ~F.col("is_secondary")
    named = aln_g.withColumn("key", F.col("chrom").cast("string"))
    kinds = dict(named.select(*place).dtypes)
    here = named.groupBy(*READ).agg(
        F.collect_list(F.struct(*place, "score")).alias("_all"), F.max(F.when(primary, F.col("score"))).alias("best"), F.min(F.when(primary, F.col("nh"))).alias("least"),
        F.count_if(primary & F.col("nh").isNull()).alias("missing"), F.max(primary.cast("int")).alias("has"),
    )
    key = (F.col("transcript_id") if "transcript_id" in aln_t.columns else F.lit(None)).cast("string").alias("key")
    there = aln_t.select(*READ, key).repartition("read_id").groupBy(*READ).agg(F.sort_array(F.collect_list(F.struct("key"))).alias("_t")).select(F.col("sample").alias("_sample"), F.col("read_id").alias("_read"), "_t")
    both = here.join(there, (F.col("read_id") == F.col("_read")) & (F.col("sample") <= F.col("_sample")) & (F.col("sample") >= F.col("_sample")), "full_outer")
    genome = F.when(F.col("missing") > 0, F.raise_error(F.lit("primary alignment without NH")).cast("string")).when((F.col("has") == 1) & (F.col("least") == 1), "unique").when(F.col("has") == 1, "multi")
    top = F.filter(F.when(F.col("has") == 1, F.col("_all")), lambda x: qualifies(x["is_secondary"], x["score"], F.col("best")))
    none = F.array().cast(f"array<struct<{','.join(f'{c}:{kinds[c]}' for c in place)}>>")
    listed = F.coalesce(F.sort_array(F.transform(top, lambda x: F.struct(*(x[c].alias(c) for c in place)))), none)
    return both.select(F.coalesce("sample", "_sample").alias("sample"), F.coalesce("read_id", "_read").alias("read_id"), listed.alias("_g"), "_t", genome.alias("genome"))


def place_columns(aln_g: DataFrame) -> list[str]:
    """What a placement of ``listed_reads`` tells."""
    return ["key", "pos", "epos", "strand", "is_secondary", *(["blocks"] if "blocks" in aln_g.columns else [])]


def counted_kinds(aln_g: DataFrame, aln_t: DataFrame) -> DataFrame:
    """``read_kinds`` of ``tagged_reads``, with less shuffled: placements are listed by read on each route, and the lists are joined.

    What can be told from a placement (first base, blocks) is told after the kinds are counted.
    """
    place = place_columns(aln_g)
    kinds = dict(aln_g.withColumn("key", F.col("chrom").cast("string")).select(*place).dtypes)
    counted = listed_reads(aln_g, aln_t).groupBy("sample", "_g", "_t", "genome").agg(F.min("read_id").alias("read_id"), F.count("*").alias("n"))
    fixed = {"pos": F.lit(0), "epos": F.lit(1), "is_secondary": F.lit(False)}
    row = lambda route, of: F.struct(F.lit(route).alias("route"), *(of(c).cast(kinds[c]).alias(c) for c in place))
    rows_ = F.concat(
        F.transform("_g", lambda x: row(0, lambda c: x[c])),
        F.transform(F.coalesce("_t", F.array().cast("array<struct<key:string>>")), lambda x: row(1, lambda c: x["key"] if c == "key" else fixed.get(c, F.lit(None)))),
    )
    told = counted.select(*READ, "n", "genome", F.col("_t").isNotNull().alias("present"), F.posexplode(rows_).alias("place", "_row"))
    return with_blocks(with_five_prime(told.select(*READ, "n", "genome", "present", (F.col("place") + 1).alias("place"), "_row.*")))
