"""The counted gene partition where neither reads nor genes are alike, against the one that goes read by read."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from twinroute.operators import coverage, genes, intervals

EXON = "gene_id long, transcript_id long, chrom string, g_start long, g_end long, strand string, gene_type string"
PLACE = "sample string, read_id long, chrom string, pos long, epos long, strand string, qlen int, score int, nh int, is_secondary boolean"


def annotation(spark, rng, n):
    rows = []
    for g in range(n):
        kind, strand, chrom = rng.choice(["protein_coding", "protein_coding", "processed_pseudogene", "lncRNA"]), rng.choice("+-"), rng.choice("ab")
        for t in range(2):
            rows += [(g, 2 * g + t, "b" if g == 5 and t else chrom, s, s + rng.randint(0, 45), strand, kind) for s in (rng.randint(0, 260) for _ in range(3))]
    return spark.createDataFrame(rows, EXON)


def placements(spark, rng, n):
    rows, other = [], []
    for r in range(n):
        k, sample = rng.choice([0, 1, 1, 2, 3, 4]), rng.choice("st")
        nh = 1 if rng.random() < 0.3 else max(k, 1)
        for i in range(k):
            p = rng.randint(0, 280)
            rows.append((sample, r, rng.choice("aab"), p, p + rng.randint(0, 60), rng.choice("+-"), 30, rng.choice([0, 0, 0, -1]) if i else 0, nh, i > 0))
        if k == 0 or rng.random() < 0.5:
            other += [(sample, r, 2 * rng.randint(0, 11) + rng.choice([0, 0, 1])) for _ in range(rng.choice([1, 1, 2]))]
    return spark.createDataFrame(rows, PLACE), spark.createDataFrame(other, "sample string, read_id long, transcript_id long")


@pytest.mark.parametrize("blocks", [False, True])
def test_counts_equal_the_reads_where_nothing_is_alike(spark, blocks):
    rng = random.Random(3)
    exons, (g, t) = annotation(spark, rng, 12), placements(spark, rng, 400)
    if blocks:
        # a third of the placements has a gap
        cut = F.array(F.struct(F.col("pos").alias("start"), (F.col("pos") + 8).alias("end")), F.struct((F.col("pos") + 20).alias("start"), F.col("epos").alias("end")))
        g = g.withColumn("blocks", F.when((F.col("read_id") % 3 == 0) & (F.col("epos") - F.col("pos") > 30), cut).otherwise(F.array(F.struct(F.col("pos").alias("start"), F.col("epos").alias("end")))))
    selected = genes.selected_transcripts(exons)
    told = ["gene_id", "sample", "genome_side", "txome_side", "genome", "present", "category", "segment"]
    want = genes.partition_reads(g, t, exons, selected, 64).groupBy(*told).agg(F.count("*").alias("n"))
    rows = lambda df: sorted(map(str, df.select(*told, "n").collect()))
    got, wanted = rows(genes.partition_counts(g, t, exons, selected, 64)), rows(want)
    assert got == wanted and len({r.category for r in want.select("category").distinct().collect()}) >= 9


def test_no_pair_of_read_and_gene_is_formed(spark, monkeypatch):
    """300 different reads at a locus of 40 different genes meet spans and exons, not genes."""
    exons = spark.createDataFrame([(g, g, "a", s, s + 100 + g, "+", "protein_coding") for g in range(40) for s in (0, 300)], EXON)
    g = spark.createDataFrame([("s", r, "a", r, r + 30 + r % 7, "+", 30, 0, 2, False) for r in range(300)], PLACE)
    t = spark.createDataFrame([("s", 1, 3)], "sample string, read_id long, transcript_id long")
    met = []
    for name in ("overlap_join", "point_join"):
        def watched(*args, _join=getattr(intervals, name), **kwargs):
            met.append(_join(*args, **kwargs))
            return met[-1]

        monkeypatch.setattr(intervals, name, watched)
    counted = genes.partition_counts(g, t, exons, genes.selected_transcripts(exons), 64)
    assert sum(df.count() for df in met) < 300
    assert counted.agg(F.sum("n")).first()[0] == 40 * 300 + 0


def test_short_blocks_meet_looks_not_transcripts(spark, monkeypatch):
    """60 transcripts that differ far from the reads look alike near them; a long block still meets each."""
    exons = spark.createDataFrame([(t, t, "a", s, e, "+", "lncRNA") for t in range(60) for s, e in ((0, 50), (400, 410 + t))], EXON)
    kind = "sample string, read_id long, chrom string, strand string, pos long, epos long"
    short = [("s", r, "a", "+", r, r + 30) for r in range(60)]
    met, join = [], intervals.overlap_join

    def watched(*args):
        met.append(join(*args))
        return met[-1]

    monkeypatch.setattr(intervals, "overlap_join", watched)
    for rows, pairs in ((short, 0), ([*short, ("s", 99, "a", "+", 30, 430)], 120)):
        blocks = spark.createDataFrame(rows, kind)
        got = coverage.best_overlap(blocks, exons, 64)
        assert met[-1].count() == pairs
        want = coverage.max_overlap(coverage.overlap_sums(blocks, exons, 64))
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
        assert {r["n_tied"] for r in got.where("read_id < 50").collect()} == {60}
