"""Exclusive read categories per library: taxonomy, pseudogene ties, reach.

Exons have gene_id, transcript_id, chrom, g_start, g_end, strand, gene_type.  The selected transcript of a
gene is given by a table (gene_id, transcript_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinroute.functions.columns import biotype_rank, taxonomy_cell
from twinroute.operators import intervals
from twinroute.operators.alignments import READ, genome_reads, present_reads, tagged_reads, with_blocks
from twinroute.operators.unions import stacked

# Fixed names of the cells, tie categories, biotypes and reach classes.
CELLS = ("sh_u", "go_u", "sh_m", "go_m", "to")
TIES = ("cross_pc_pp", "cross_pp_pc", "same_pc_pc", "same_pp_pp")
CODING, PSEUDO = "protein_coding", "processed_pseudogene"
REACH = (
    "intronic", "intergenic", "protein_coding_gene_omitted", "pseudogene", "non_protein_coding_gene",
    "representable_not_present_in_dedup_bam", "nonselected_isoform_exon", "splice_junction_absent", "other_unclassified",
)


def share(n: Column, total: Column) -> Column:
    return F.when(total > 0, F.lit(100.0) * n / total)


def read_cells(aln_g: DataFrame, aln_t: DataFrame) -> DataFrame:
    """sample, read_id, genome (unique, multi or null), present and cell of every read of either route."""
    there = present_reads(aln_t).withColumn("present", F.lit(True))
    both = genome_reads(aln_g).join(there, READ, "full_outer").withColumn("present", F.coalesce("present", F.lit(False)))
    return both.withColumn("cell", taxonomy_cell(F.col("genome"), F.col("present")))


def taxonomy(aln_g: DataFrame, aln_t: DataFrame) -> DataFrame:
    """The five-category row of every library with marginals and shares."""
    n = lambda when, name: F.count_if(when).alias(name)
    counted = read_cells(aln_g, aln_t).groupBy("sample").agg(
        F.count("*").alias("n_universe"),
        *(n(F.col("cell") == c, f"n_{c}") for c in CELLS),
        n(F.col("genome") == "unique", "n_genome_unique"),
        n(F.col("genome") == "multi", "n_genome_multi"),
        n(F.col("genome").isNull(), "n_genome_absent"),
        n(F.col("present"), "n_txome_present"),
        n(~F.col("present"), "n_txome_absent"),
    )
    return counted.select("*", *(share(F.col(f"n_{c}"), F.col("n_universe")).alias(f"pct_{c}") for c in CELLS))


def taxonomy_violations(rows: DataFrame, least_overlap: float = 5.0) -> DataFrame:
    """Rows whose cells do not sum to the universe, or whose routes hardly share a read."""
    cells = sum((F.col(f"n_{c}") for c in CELLS), F.lit(0))
    shared = F.lit(100.0) * (F.col("n_sh_u") + F.col("n_sh_m")) / F.col("n_universe")
    return rows.select("sample", (cells != F.col("n_universe")).alias("sum_differs"), (shared <= least_overlap).alias("low_overlap")).where("sum_differs OR low_overlap")


def gene_bodies(exons: DataFrame) -> DataFrame:
    return exons.groupBy("gene_id", "chrom").agg(F.min("g_start").alias("b_start"), F.max("g_end").alias("b_end"))


def locus_biotype(places: DataFrame, exons: DataFrame, point: str = "p5", width: int = intervals.BIN) -> DataFrame:
    """places (chrom, point) with ``biotype``: the best-ranked exon type at the point,
    else ``intronic`` in a gene body, else ``intergenic``.  Strand plays no part.

    Distinct points meet distinct (span, type) exons, so neither deep reads nor repeated exons multiply."""
    at = ["chrom", point]
    spot = places.select(*at).distinct()
    hit = intervals.point_join(spot, exons.select("chrom", "g_start", "g_end", "gene_type").distinct(), ["chrom"], point, ("g_start", "g_end"), width)
    best = hit.groupBy(*at).agg(F.min(F.struct(biotype_rank(F.col("gene_type")), "gene_type"))["gene_type"].alias("exon_type"))
    bodies = intervals.merge(gene_bodies(exons), ["chrom"], "b_start", "b_end")
    inside = intervals.point_join(spot, bodies, ["chrom"], point, ("b_start", "b_end"), width).select(*at).distinct().withColumn("in_body", F.lit(True))
    # null points and chromosomes are places too
    told = best.join(inside, at, "full_outer")
    named = places.join(told, at, "left")
    biotype = F.coalesce("exon_type", F.when(F.col("in_body"), "intronic").otherwise("intergenic"))
    return named.select(*places.columns, biotype.alias("biotype"))


def numbered(aln: DataFrame) -> DataFrame:
    """Placements with an id: the read and the placement's place among the read's."""
    order = Window.partitionBy(*READ).orderBy("is_secondary", "chrom", "pos", "epos", "strand", "score")
    return aln.withColumn("place", F.struct("sample", "read_id", F.row_number().over(order).alias("k")))


def tie_labels(aln_g: DataFrame, aln_t: DataFrame, exons: DataFrame, width: int = intervals.BIN) -> DataFrame:
    """sample, read_id and tie category (null for none) of multimapped reads that are on the other route too.

    A shuffle by read tells populations, ties and places; the best-ranked exon type at each place is a grouping by place, and
    the label one by read.
    """
    places = tagged_reads(aln_g, aln_t).where("route = 0 AND genome = 'multi' AND present").select(*READ, "place", F.col("key").alias("chrom"), "p5", "is_secondary")
    types = exons.select("chrom", "g_start", "g_end", "gene_type").distinct()
    hit = intervals.point_join(places, types, ["chrom"], "p5", ("g_start", "g_end"), width)
    kind = F.struct(biotype_rank(F.col("gene_type")).alias("r"), "gene_type")
    rows = stacked(hit.select(*READ, "place", "is_secondary", kind.alias("kind")), places.select(*READ, "place", "is_secondary"), missing=True)
    typed = rows.repartition(*READ).groupBy(*READ, "place").agg(F.max("is_secondary").alias("is_secondary"), F.min("kind")["gene_type"].alias("biotype"))
    # a secondary is only here if it ties with the primary
    tied = F.col("is_secondary")
    flags = typed.groupBy(*READ).agg(
        F.min(F.when(~F.col("is_secondary"), F.col("biotype"))).alias("p"),
        F.bool_or(tied & F.coalesce(F.col("biotype") == CODING, F.lit(False))).alias("pc"),
        F.bool_or(tied & F.coalesce(F.col("biotype") == PSEUDO, F.lit(False))).alias("pp"),
    )
    pc, pp = F.col("pc"), F.col("pp")
    label = (
        F.when((F.col("p") == CODING) & pp, "cross_pc_pp")
        .when((F.col("p") == PSEUDO) & pc, "cross_pp_pc")
        .when((F.col("p") == CODING) & pc, "same_pc_pc")
        .when((F.col("p") == PSEUDO) & pp, "same_pp_pp")
    )
    return flags.select(*READ, label.alias("label"))


def tie_rows(labels: DataFrame) -> DataFrame:
    counted = labels.groupBy("sample").agg(F.count("*").alias("n_reads"), *(F.count_if(F.col("label") == t).alias(t) for t in TIES), F.count("label").alias("n_qualifying"))
    return counted.select("*", *(share(F.col(t), F.col("n_reads")).alias(f"pct_{t}") for t in (*TIES, "n_qualifying")))


def omitted_exons(exons: DataFrame, selected: DataFrame, width: int | None = None) -> DataFrame:
    """Per gene, exonic sequence (start, end) that its selected transcript leaves out; only genes with one."""
    spans = exons.select("gene_id", "transcript_id", "chrom", F.col("g_start").alias("start"), F.col("g_end").alias("end"))
    own = spans.join(selected, ["gene_id", "transcript_id"], "left_semi")
    genes = spans.join(selected.select("gene_id"), "gene_id", "left_semi")
    return intervals.subtract(genes.drop("transcript_id"), own.drop("transcript_id"), ["gene_id", "chrom"], width=width)


def tagged_exons(exons: DataFrame, selected: DataFrame) -> DataFrame:
    """Distinct exons (gene_id, chrom, s, e, gene_type) with ``rank`` (selected coding, other coding, pseudogene, other), the gene's selected
    transcript ``own``, and ``x`` and ``x_strand`` where the exon is that transcript's: its place and strand."""
    own = exons.join(selected.select("gene_id", F.col("transcript_id").alias("own")), "gene_id", "left")
    ranked = own.withColumn("_x", F.row_number().over(Window.partitionBy("transcript_id").orderBy("g_start", "g_end")))
    is_own = F.col("transcript_id") == F.col("own")
    distinct = ranked.groupBy("gene_id", "chrom", F.col("g_start").alias("s"), F.col("g_end").alias("e"), "gene_type").agg(
        F.min("own").alias("own"), F.min(F.when(is_own, F.col("_x"))).alias("x"), F.min(F.when(is_own, F.col("strand"))).alias("x_strand")
    )
    rank = F.when((F.col("gene_type") == CODING) & F.col("own").isNotNull(), 0).when(F.col("gene_type") == CODING, 1).when(F.col("gene_type").contains("pseudogene"), 2).otherwise(3)
    return distinct.withColumn("rank", rank)


def one_of_each(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans of one gene of each class, members (gene_id, of)): genes of a class have the same spans, and the least id stands for them."""
    own = F.struct(*(c for c in spans.columns if c not in ("gene_id", "own")))
    listed = spans.groupBy("gene_id").agg(F.sort_array(F.collect_list(own)).alias("_spans"), *([F.min("own").alias("own")] if "own" in spans.columns else []))
    named = listed.withColumn("of", F.min("gene_id").over(Window.partitionBy("_spans")))
    one = named.where("gene_id = of").drop("of").withColumn("_span", F.explode("_spans")).drop("_spans")
    return one.select("*", "_span.*").drop("_span"), named.select("gene_id", "of")


def inside_blocks() -> Column:
    """The blocks that [s, e) holds, as (k, x): the block's place and the exon's."""
    all_ = F.transform("blocks", lambda b, k: F.struct(k.alias("k"), ((F.col("s") <= b["start"]) & (b["end"] <= F.col("e"))).alias("ok"), F.col("x").alias("x")))
    return F.transform(F.filter(all_, lambda q: q["ok"]), lambda q: F.struct(q["k"].alias("k"), q["x"].alias("x")))


def fits_transcript(fit: Column, n_blocks: Column) -> Column:
    """Verdict from the blocks that a transcript's exons hold: each block's first exon, and one step up in the genome as one step in the transcript."""
    steps = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda k: F.array_min(F.transform(F.filter(fit, lambda q: q["k"] == k), lambda q: q["x"])) - k)
    return F.when(F.exists(steps, lambda v: v.isNull()), "nonselected_isoform_exon").when(F.size(F.array_distinct(steps)) == 1, "representable_not_present_in_dedup_bam").otherwise("splice_junction_absent")


def reach_labels(reads: DataFrame, exons: DataFrame, selected: DataFrame, width: int = intervals.BIN) -> DataFrame:
    """sample, read_id, label (one of ``REACH``) of unique genome reads; and the overlap with omitted exons.

    Genes at the read's span are taken in the order selected coding, other coding, pseudogene, other; ties by gene id.  One interval
    join against exons, gene bodies and omitted sequence together, and one grouping by read.
    """
    reads = with_blocks(reads)
    bodies = intervals.merge(gene_bodies(exons), ["chrom"], "b_start", "b_end").select("chrom", F.col("b_start").alias("s"), F.col("b_end").alias("e"))
    omitted = intervals.merge(omitted_exons(exons, selected).drop("gene_id"), ["chrom"]).select("chrom", F.col("start").alias("s"), F.col("end").alias("e"))
    spans = stacked(one_of_each(tagged_exons(exons, selected))[0].withColumn("role", F.lit("exon")), bodies.withColumn("role", F.lit("body")), omitted.withColumn("role", F.lit("omitted")), missing=True)
    here = reads.select(*READ, "chrom", "strand", "pos", "epos", "blocks")
    met = intervals.overlap_join(here, spans, ["chrom"], ("pos", "epos"), ("s", "e"), width)
    is_ = lambda role: F.col("role") == role
    own = F.when(is_("exon") & F.col("x").isNotNull() & (F.col("x_strand") == F.col("strand")), F.transform(inside_blocks(), lambda q: F.struct(F.col("own").alias("own"), q["k"].alias("k"), q["x"].alias("x"))))
    facts = met.select(
        *READ, F.when(is_("exon"), F.struct("rank", "gene_id", "own")).alias("best"), is_("body").alias("in_body"),
        (is_("omitted") & F.exists("blocks", lambda b: (b["start"] < F.col("e")) & (F.col("s") < b["end"]))).alias("on_omitted"), own.alias("fit"), F.size("blocks").alias("n_blocks"),
    )
    whole = stacked(facts, reads.select(*READ), missing=True).groupBy(*READ).agg(
        F.min("best").alias("best"), F.coalesce(F.bool_or("in_body"), F.lit(False)).alias("in_body"), F.coalesce(F.bool_or("on_omitted"), F.lit(False)).alias("on_omitted"),
        F.flatten(F.collect_list("fit")).alias("fit"), F.max("n_blocks").alias("n_blocks"),
    )
    mine = F.filter("fit", lambda q: q["own"] == F.col("best.own"))
    label = (
        F.when(F.col("best.rank") == 0, fits_transcript(mine, F.col("n_blocks")))
        .when(F.col("best.rank") == 1, "protein_coding_gene_omitted")
        .when(F.col("best.rank") == 2, "pseudogene")
        .when(F.col("best.rank") == 3, "non_protein_coding_gene")
        .when(F.col("in_body"), "intronic")
        .otherwise("intergenic")
    )
    return whole.select(*READ, label.alias("label"), "on_omitted")


def genome_only_unique(aln_g: DataFrame, aln_t: DataFrame) -> DataFrame:
    """Primary placements of reads in cell go_u."""
    wanted = read_cells(aln_g, aln_t).where("cell = 'go_u'").select(*READ)
    return aln_g.where("NOT is_secondary").join(wanted, READ, "left_semi")


def reach_rows(aln_g: DataFrame, aln_t: DataFrame, exons: DataFrame, selected: DataFrame, width: int = intervals.BIN) -> DataFrame:
    unique = tagged_reads(aln_g, aln_t).where("route = 0 AND place = 1 AND genome = 'unique'").withColumnRenamed("key", "chrom")
    cells = unique.groupBy("sample").agg(F.count("*").alias("n_genome_unique"), F.count_if("present").alias("n_sh_u"), F.count_if(~F.col("present")).alias("n_go_u"))
    # reads of equal blocks have one label: the one of least id stands for them
    kinds = unique.where("NOT present").groupBy("sample", "chrom", "strand", "pos", "epos", "blocks").agg(F.min("read_id").alias("read_id"), F.count("*").alias("n"))
    labels = reach_labels(kinds, exons, selected, width).join(kinds.select(*READ, "n"), READ)
    n = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    counted = labels.groupBy("sample").agg(*(n(F.col("label") == c).alias(f"n_{c}") for c in REACH), n(F.col("on_omitted")).alias("n_omitted_exon_overlap"))
    joined = cells.join(counted, "sample", "left").fillna(0)
    return joined.select("*", *(share(F.col(f"n_{c}"), F.col("n_go_u")).alias(f"pct_{c}") for c in (*REACH, "omitted_exon_overlap")))
