"""Operators that count kinds of reads and classes of genes against those that go read by read."""

from __future__ import annotations

from functools import reduce

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from twinroute.operators import alignments, annotate, categories, counts, coverage, genes, intervals, locus
from twinroute.plans import position_queries, views


def repeated(df, times, **shifts):
    """df several times over with shifted keys, as deep tables have it: equal structures under many ids."""
    parts = [df.select(*((F.col(c) + i * shifts[c]).alias(c) if c in shifts else F.col(c) for c in df.columns)) for i in range(times)]
    return reduce(lambda a, b: a.unionByName(b), parts)


@pytest.fixture(scope="module")
def deep(spark, sf):
    g, t, exons = (views.view(spark, sf, n) for n in ("aln_g", "aln_t", "exons"))
    return repeated(g, 3, read_id=6_000_000), repeated(t, 3, read_id=6_000_000), repeated(exons, 2, gene_id=1000, transcript_id=2000)


def same(a, b):
    b = b.select(*a.columns)
    assert a.count() > 0 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_partition_counts_equal_the_reads(spark, deep):
    g, t, exons = deep
    selected = genes.selected_transcripts(exons)
    told = ["gene_id", "sample", "genome_side", "txome_side", "genome", "present", "category", "segment"]
    reads = genes.partition_reads(g, t, exons, selected, 256)
    counted = genes.partition_counts(g, t, exons, selected, 256)
    same(counted, reads.groupBy(*told).agg(F.count("*").alias("n")))
    same(genes.category_table(counted), genes.category_table(reads))
    same(genes.segment_table(counted), genes.segment_table(reads))


def test_kinds_by_joined_lists_equal_those_of_all_placements(spark, deep):
    g, t, _ = deep
    # a read id in two samples, a read on one route twice, one without primary and one with blocks of its own
    g = g.unionByName(g.where("read_id % 5 = 0").withColumn("sample", F.lit("z"))).where("is_secondary OR read_id % 7 <> 0")
    t = t.unionByName(t.where("read_id % 3 = 0").withColumn("transcript_id", F.col("transcript_id") + 1)).unionByName(t.limit(5).withColumn("transcript_id", F.lit(None).cast("long")))
    block = F.array(F.struct(F.col("pos").alias("start"), F.col("epos").alias("end")))
    for aln in (g, g.withColumn("blocks", block)):
        want = alignments.read_kinds(alignments.tagged_reads(aln, t))
        same(alignments.counted_kinds(aln, t).drop("place"), want.drop("place"))


def test_the_partition_moves_the_alignments_once(spark, sf):
    """One shuffle of the rows of lineitem; those of orders go to them."""
    g, t = views.view(spark, sf, "aln_g", by_read=True), views.view(spark, sf, "aln_t")
    plan = alignments.counted_kinds(g, t)._jdf.queryExecution().executedPlan().toString()
    # lineitem by order, orders by read, kinds
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 3


def test_classes_meet_each_kind_once(spark, deep):
    """The interval join sees one gene of a class and one read of a kind."""
    _, _, exons = deep
    spans = genes.tagged_spans(exons, genes.selected_transcripts(exons)).where("route = 0")
    classes, members = categories.one_of_each(spans)
    assert members.count() == exons.select("gene_id").distinct().count()
    assert 2 * classes.count() == spans.count()


def test_end_hits_are_two_rows_at_most(spark, deep):
    g, _, exons = deep
    points = alignments.with_five_prime(g.where("NOT is_secondary")).select("sample", "read_id", "chrom", "strand", "p5")
    hits, ends = coverage.point_hits(points, exons, width=256), coverage.end_hits(points, exons, width=256)
    assert ends.groupBy("sample", "read_id").count().agg(F.max("count")).first()[0] <= 2
    same(coverage.first_hit(ends), coverage.first_hit(hits))
    same(counts.count_totals(ends, points), counts.count_totals(hits, points))


def test_first_hits_read_the_points_once(spark, deep):
    """First hits of one and of two stages equal those of all pairs, with one scan and one sort of the alignments."""
    g, _, exons = deep
    points = alignments.with_five_prime(g.where("NOT is_secondary")).select("sample", "read_id", "chrom", "strand", "p5")
    # a second point for some reads, and exons that are empty or touch
    points = points.unionByName(points.where("read_id % 3 = 0").withColumn("p5", F.col("p5") + 7)).unionByName(points.limit(3).withColumn("p5", F.lit(None).cast("long")))
    exons = exons.unionByName(exons.limit(5).withColumn("g_end", F.col("g_start"))).unionByName(exons.limit(5).withColumn("g_start", F.col("g_end")).withColumn("g_end", F.col("g_end") + 40))
    same(coverage.first_hits(points, exons, width=256), coverage.first_hit(coverage.point_hits(points, exons, width=256)))
    coding = exons.where("gene_type = 'protein_coding'")
    one = coverage.first_hit(coverage.point_hits(points, coding, width=256)).withColumn("stage", F.lit(1))
    rest = points.join(one.select("sample", "read_id"), ["sample", "read_id"], "left_anti")
    two = coverage.first_hit(coverage.point_hits(rest, exons, width=256)).withColumn("stage", F.lit(2))
    same(coverage.two_stage(points, coding, exons, 256), one.unionByName(two))


@pytest.mark.parametrize("name", ["point_first_hit", "two_stage_assign"])
def test_primaries_are_told_in_one_scan_without_a_sort_of_it(spark, sf, name):
    plan = position_queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("l_extendedprice#") and plan.split("Initial Plan")[-1].count("FileScan parquet [l_orderkey") == 1 and "WindowGroupLimit" not in plan


def test_best_overlap_and_totals_equal_the_pairs(spark, deep):
    g, _, exons = deep
    blocks = g.where("NOT is_secondary").select("sample", "read_id", "chrom", "strand", "pos", "epos")
    # two blocks for some reads
    blocks = blocks.unionByName(blocks.where("read_id % 3 = 0").withColumn("pos", F.col("epos") + 50).withColumn("epos", F.col("epos") + 60))
    sums = coverage.overlap_sums(blocks, exons, 256)
    top = sums.withColumn("top", F.max("n_overlap").over(Window.partitionBy("sample", "read_id"))).groupBy("sample", "read_id").agg(F.count("*").alias("n_transcripts"), F.count_if(F.col("n_overlap") == F.col("top")).alias("n_tied"))
    same(coverage.best_overlap(blocks, exons, 256), coverage.max_overlap(sums).join(top, ["sample", "read_id"]))
    met = intervals.overlap_join(blocks, exons, ["chrom", "strand"], ("pos", "epos"), ("g_start", "g_end"), 256)
    size = intervals.overlap_length(F.col("pos"), F.col("epos"), F.col("g_start"), F.col("g_end"))
    same(coverage.transcript_overlaps(blocks, exons, 512), met.groupBy("sample", "transcript_id").agg(F.count("*").alias("n_pairs"), F.sum(size).alias("n_bases")))


EXON = "gene_id long, transcript_id long, chrom string, g_start long, g_end long, strand string, gene_type string"


def test_biotype_of_points_needs_no_place(spark):
    exons = spark.createDataFrame([(k, k, "a", 10, 20, "+", "lncRNA" if k % 2 else "protein_coding") for k in range(6)] + [(9, 9, "a", 100, 110, "+", "lncRNA"), (9, 9, "a", 150, 160, "+", "lncRNA")], EXON)
    places = spark.createDataFrame([("a", 12, 5), ("a", 12, 7), ("a", 120, 1), ("a", 99, 2), ("b", 12, 3), ("a", None, 4)], "chrom string, p5 long, n int")
    got = {r["n"]: r["biotype"] for r in categories.locus_biotype(places, exons, width=16).collect()}
    assert got == {5: "protein_coding", 7: "protein_coding", 1: "intronic", 2: "intergenic", 3: "intergenic", 4: "intergenic"}


def test_overlap_class_of_a_repeated_id(spark):
    """An id with two spans has the class of each span, not one for both."""
    spans = spark.createDataFrame([(1, "a", 0, 10), (1, "a", 50, 60), (2, "a", 0, 10)], "id int, chrom string, start long, end long")
    classes = spark.createDataFrame([("a", 0, 3, "x"), ("a", 0, 3, "x"), ("a", 2, 10, "y"), ("a", 50, 51, "z")], "chrom string, c_start long, c_end long, category string")
    got = sorted((r["id"], r["start"], r["category"]) for r in annotate.largest_overlap(spans, classes, ["chrom"]).collect())
    assert got == [(1, 0, "y"), (1, 50, "z"), (2, 0, "y")]


def test_stored_is_not_worked_out_again(spark):
    slow = spark.range(20).groupBy((F.col("id") % 3).alias("k")).agg(F.count("*").alias("n"))
    kept = views.stored(slow)
    plan = kept.where("k = 1")._jdf.queryExecution().optimizedPlan().toString()
    assert kept.count() == 3 and ("InMemoryRelation" in plan or "Aggregate" not in plan)


def test_reach_of_kinds_equals_the_reads(spark):
    exons = spark.createDataFrame([(g, 2 * g + k, "a", s, s + 40, "+", "protein_coding") for g in range(4) for k, s in ((0, 10), (0, 100), (1, 200))], EXON)
    selected = genes.selected_transcripts(exons)
    aln = spark.createDataFrame([("s", i, "a", p, p + 20, "+", 20, 0, 1, False) for i, p in enumerate([15, 15, 15, 205, 205, 60, 900])], "sample string, read_id long, chrom string, pos long, epos long, strand string, qlen int, score int, nh int, is_secondary boolean")
    row = categories.reach_rows(aln, spark.createDataFrame([("s", 99, 0)], "sample string, read_id long, transcript_id long"), exons, selected, 64).first()
    assert (row["n_go_u"], row["n_representable_not_present_in_dedup_bam"], row["n_nonselected_isoform_exon"], row["n_intronic"], row["n_intergenic"], row["n_omitted_exon_overlap"]) == (7, 3, 2, 1, 1, 2)


def test_counted_artifacts_equal_the_sites(spark):
    one = [(1, 10, "c", 0, 10, "+", "protein_coding"), (1, 10, "c", 20, 30, "+", "protein_coding"), (1, 11, "c", 8, 15, "+", "protein_coding")]
    exons = spark.createDataFrame([(g + k, t + 10 * k, *rest) for k in range(3) for g, t, *rest in one], EXON)
    placed = [(1, 5, 9, 1, False), (2, 5, 9, 1, False), (3, 22, 26, 2, False), (3, 24, 28, 2, True), (4, 17, 22, 1, False), (5, 5, 9, 1, False)]
    g = spark.createDataFrame([("s", i, "c", p, e, "+", e - p, 0, nh, sec) for i, p, e, nh, sec in placed], "sample string, read_id long, chrom string, pos long, epos long, strand string, qlen int, score int, nh int, is_secondary boolean")
    t = spark.createDataFrame([("s", 1, 10, 2), ("s", 3, 20, 9), ("s", 9, 10, 11), ("s", 8, 20, 40), ("r", 7, 30, 1)], "sample string, read_id long, transcript_id long, pos long")
    selected = genes.selected_transcripts(exons)
    flat = lambda df: sorted(str(r.asDict(recursive=True)) for r in df.select("gene_id", "sample", "exons", "layers", "tracks", "counts").collect())
    want = flat(locus.locus_artifact(locus.locus_sites(g, t, exons, selected, 3, 16), exons, 16))
    assert len(want) == 4 and flat(locus.counted_artifacts(g, t, exons, selected, 3, 16)) == want


def test_partner_lists_equal_pairs_and_meet_by_chain(spark, deep, monkeypatch):
    exons = deep[2]
    a, b = exons.alias("a"), exons.alias("b")
    over = (F.col("a.chrom") == F.col("b.chrom")) & (F.col("a.strand") == F.col("b.strand")) & (F.col("a.g_start") < F.col("b.g_end")) & (F.col("b.g_start") < F.col("a.g_end"))
    p = a.join(b, over & (F.col("a.transcript_id") != F.col("b.transcript_id"))).select("a.transcript_id", F.col("b.transcript_id").alias("partner"), (F.col("a.gene_id") == F.col("b.gene_id")).alias("same_gene")).distinct()
    pairs = p.groupBy("transcript_id").agg(F.count("*").alias("n_partners"), F.array_join(F.array_sort(F.collect_list("partner")).cast("array<string>"), ";").alias("partners"), F.count_if(~F.col("same_gene")).alias("n_other_gene"))
    met, join = [], intervals.overlap_join

    def watched(*args):
        met.append(join(*args))
        return met[-1]

    monkeypatch.setattr(intervals, "overlap_join", watched)
    same(annotate.partner_lists(exons, width=256), pairs)
    once = exons.where("transcript_id < 2000")
    annotate.partner_lists(once, width=256)
    # twice the annotation under other ids meets no more rows
    assert met[0].count() == met[-1].count()
