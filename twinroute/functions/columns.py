"""Column expressions of the alignment model: flags, placement, CIGAR, regions, frames, classes.

All are built-in Spark expressions: nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
UNMAPPED, SECONDARY, SUPPLEMENTARY, REVERSE, PAIRED = 4, 256, 2048, 16, 1
NOT_PRIMARY = UNMAPPED | SECONDARY | SUPPLEMENTARY
MIN_MAPQ = 42
LENGTH_RANGE = (20, 45)
REGION_LEFT, REGION_RIGHT = 35, 10
MIN_UTR, MIN_CDS = 30, 150
REGION_LABELS = ("UTR5", "CDS", "UTR3")


def flag_set(flag: Column, bits: int) -> Column:
    return flag.bitwiseAND(F.lit(bits)) != 0


def strand_of(flag: Column) -> Column:
    return F.when(flag_set(flag, REVERSE), "-").otherwise("+")


def is_primary(flag: Column) -> Column:
    """Mapped, not secondary, not supplementary: presence on a route."""
    return ~flag_set(flag, NOT_PRIMARY)


def is_unique_genome(flag: Column, nh: Column) -> Column:
    """Primary with one reported placement.  A primary without NH is not decided here: see checks.missing_nh."""
    return is_primary(flag) & (nh == 1)


def is_unique_transcriptome(flag: Column, mapq: Column, least: int = MIN_MAPQ) -> Column:
    return is_primary(flag) & (mapq >= least)


def in_length_range(qlen: Column, least: int = LENGTH_RANGE[0], most: int = LENGTH_RANGE[1]) -> Column:
    return qlen.between(least, most)


def five_prime(start: Column, end: Column, strand: Column) -> Column:
    return F.when(strand == "-", end - 1).otherwise(start)


def operations(cigar: Column) -> Column:
    """CIGAR as array<struct<n, op>>."""
    return F.transform(F.regexp_extract_all(cigar, F.lit("([0-9]+[MIDNSHP=X])"), F.lit(1)), lambda x: F.struct(F.regexp_extract(x, "^([0-9]+)", 1).cast("int").alias("n"), F.right(x, F.lit(1)).alias("op")))


def walk(start: Column, cigar: Column) -> Column:
    """Aligned runs as array<struct<start, end, q>>: reference span and query offset of every M, = and X run."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint,q:bigint>>")
    begin = F.struct(start.cast("long").alias("ref"), F.lit(0).cast("long").alias("q"), empty.alias("runs"))

    def step(a: Column, o: Column) -> Column:
        aligned, n = o["op"].isin("M", "=", "X"), o["n"].cast("long")
        run = F.array(F.struct(a["ref"].alias("start"), (a["ref"] + n).alias("end"), a["q"].alias("q")))
        return F.struct(
            (a["ref"] + F.when(aligned | o["op"].isin("D", "N"), n).otherwise(0)).alias("ref"),
            (a["q"] + F.when(aligned | o["op"].isin("I", "S"), n).otherwise(0)).alias("q"),
            F.when(aligned, F.concat(a["runs"], run)).otherwise(a["runs"]).alias("runs"),
        )

    return F.aggregate(operations(cigar), begin, step, lambda a: a["runs"])


def blocks(start: Column, cigar: Column) -> Column:
    """Aligned blocks as array<struct<start, end>>; introns and deletions part them, insertions and clips do not move them."""
    return F.transform(walk(start, cigar), lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end")))


def psite_aligned(runs: Column, strand: Column, offset: Column) -> Column:
    """P-site by aligned bases: ``offset`` aligned bases from the 5' end; null when the read has no more than that."""
    total = F.aggregate(runs, F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    want = F.when(strand == "-", total - 1 - offset).otherwise(offset).cast("long")
    begin = F.struct(want.alias("left"), F.lit(None).cast("long").alias("at"))

    def step(a: Column, r: Column) -> Column:
        n = r["end"] - r["start"]
        here = a["at"].isNull() & (a["left"] >= 0) & (a["left"] < n)
        return F.struct((a["left"] - F.when(a["at"].isNull(), n).otherwise(0)).alias("left"), F.when(here, r["start"] + a["left"]).otherwise(a["at"]).alias("at"))

    return F.when((offset >= 0) & (offset < total), F.aggregate(runs, begin, step, lambda a: a["at"]))


def psite_query(runs: Column, strand: Column, offset: Column, qlen: Column) -> Column:
    """P-site by query offset: null when that base of the read is inserted, clipped or off the alignment."""
    want = F.when(strand == "-", qlen - 1 - offset).otherwise(offset)
    hit = F.get(F.filter(runs, lambda r: (r["q"] <= want) & (want < r["q"] + r["end"] - r["start"])), F.lit(0))
    return (hit["start"] + want - hit["q"]).cast("long")


def psite(start: Column, cigar: Column, strand: Column, offset: Column, qlen: Column, mode: str) -> Column:
    """P-site position in one of two named modes, ``aligned`` or ``query``; they differ at insertions and soft clips."""
    runs = walk(start, cigar)
    if mode == "aligned":
        return psite_aligned(runs, strand, offset)
    if mode == "query":
        return psite_query(runs, strand, offset, qlen)
    raise ValueError(f"unknown P-site mode {mode!r}")


def transcript_psite(start: Column, offset: Column, length: Column) -> Column:
    """start + offset where that lies in the transcript."""
    at = start + offset
    return F.when((at >= 0) & (at < length), at)


def clamp(position: Column, length: Column) -> Column:
    return F.greatest(F.lit(0), F.least(position, length))


def qualifies(is_secondary: Column, score: Column, primary_score: Column) -> Column:
    """Tied best: a primary always; a secondary if both scores are there and equal.  Null never ties."""
    return ~is_secondary | F.coalesce(score == primary_score, F.lit(False))


def base_id(name: Column) -> Column:
    """An id without its version."""
    return F.substring_index(name, ".", 1)


def filtered_by_length(utr5: Column, cds: Column, utr3: Column) -> Column:
    """True where a region is missing or short."""
    return (F.coalesce(utr5, F.lit(0)) < MIN_UTR) | (F.coalesce(cds, F.lit(0)) < MIN_CDS) | (F.coalesce(utr3, F.lit(0)) < MIN_UTR)


def five_regions(x: Column, start: Column, stop: Column, left: int = REGION_LEFT, right: int = REGION_RIGHT) -> Column:
    """0 UTR5, 1 start junction, 2 CDS, 3 stop junction, 4 UTR3; -1 before the transcript."""
    return (
        F.when(x < 0, -1)
        .when(x < start - left, 0)
        .when(x < start + right, 1)
        .when(x < stop - left, 2)
        .when(x < stop + right, 3)
        .otherwise(4)
    )


def coverage_state(n_events: Column, slice_sum: Column) -> Column:
    return F.when(F.coalesce(n_events, F.lit(0)) == 0, "no_reads").when(F.coalesce(slice_sum, F.lit(0)) == 0, "outside_slice").otherwise("covered")


def frame(position: Column, cds_start: Column) -> Column:
    return F.pmod(position - cds_start, F.lit(3)).cast("int")


def genomic_frame(position: Column, exon_start: Column, exon_end: Column, phase: Column, strand: Column) -> Column:
    """Frame from a CDS exon: the distance into the exon less its phase, never negative."""
    into = F.when(strand == "-", exon_end - 1 - position).otherwise(position - exon_start)
    return F.pmod(into - phase, F.lit(3)).cast("int")


def text_bool(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("true", "1"), F.lit(False))


def sample_of_path(path: Column, suffix: str) -> Column:
    return F.regexp_extract(path, "([^/]+)" + suffix.replace(".", "[.]") + "$", 1)


def label_key(name: Column) -> Column:
    """One key for labels that differ in spaces and underscores."""
    return F.lower(F.regexp_replace(F.trim(name), "[ _]+", "_"))


def mapped(value: Column, table: Mapping[str, str]) -> Column:
    """Lookup in a small fixed mapping; null if absent."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), value)


def taxonomy_cell(genome: Column, present: Column) -> Column:
    """Cell of a read: genome placement (``unique``, ``multi`` or null) against presence on the other route."""
    return (
        F.when((genome == "unique") & present, "sh_u")
        .when((genome == "multi") & present, "sh_m")
        .when(genome == "unique", "go_u")
        .when(genome == "multi", "go_m")
        .when(present, "to")
    )


def pseudogene_class(gene_type: Column) -> Column:
    """``unprocessed`` is tested first, as it holds the word ``processed``."""
    return F.when(gene_type.contains("unprocessed"), "unprocessed").when(gene_type.contains("processed"), "processed").when(gene_type.contains("pseudogene"), "other")


def biotype_rank(gene_type: Column) -> Column:
    return F.when(gene_type == "protein_coding", 0).when(gene_type == "lncRNA", 1).when(gene_type.contains("pseudogene"), 2).otherwise(3)


def utr_type(start: Column, end: Column, cds_start: Column, cds_end: Column, strand: Column) -> Column:
    """``five`` or ``three`` for a UTR before or after the CDS along the strand; null for neither."""
    before, after = end <= cds_start, start >= cds_end
    return F.when(before, F.when(strand == "-", "three").otherwise("five")).when(after, F.when(strand == "-", "five").otherwise("three"))


def longest_run(values: Column, threshold: float) -> Column:
    """Length of the longest run of consecutive values at or over a threshold."""
    begin = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, v: Column) -> Column:
        run = F.when(v >= threshold, a["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return F.aggregate(values, begin, step, lambda a: a["best"])


def number_array(text: Column) -> Column:
    return F.from_json(text, "array<double>")


def in_window(start: Column, end: Column, at: Column, to: Column) -> Column:
    """Overlap with the half-open window [at, to)."""
    return (start < to) & (end > at)
