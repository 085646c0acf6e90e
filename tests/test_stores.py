"""Coverage store, partition record, locus artifacts, slices and tracks: round trips and planted faults."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from twinroute.operators import coverage, genes, locus
from twinroute.sources import coverage_store, partition_record

SEGMENT = "sample string, signal string, transcript_id long, start long, end long, depth long"


def rows(df, *names):
    return sorted((tuple(r[n] for n in names or df.columns) for r in df.collect()), key=str)


@pytest.fixture
def store(spark, tmp_path: Path):
    segments = spark.createDataFrame([(f"s{k % 3}", locus.SIGNALS[k % 4], k % 40, k, k + 2, 1 + k % 5) for k in range(400)], SEGMENT)
    transcripts = spark.range(40).select(F.col("id").alias("transcript_id"), F.lit(500).cast("long").alias("transcript_len"), F.lit(5).alias("cds_start"), F.lit(200).alias("cds_end"))
    path = str(tmp_path / "store")
    coverage_store.write(segments, transcripts, path, "ribo", 15, buckets=8)
    return path, segments, transcripts


def test_store_round_trip_and_samples_replaced(spark, store):
    path, segments, transcripts = store
    assert rows(coverage_store.open_runs(spark, path), *segments.columns) == rows(segments)
    assert coverage_store.problems(spark, path).count() == 0
    fresh = segments.where("sample = 's1'").withColumn("depth", F.lit(9).cast("long"))
    coverage_store.write(fresh, transcripts, path, "ribo", 15, buckets=8)
    assert rows(coverage_store.open_runs(spark, path), *segments.columns) == rows(segments.where("sample <> 's1'").unionByName(fresh))


def test_one_transcript_touches_one_bucket(spark, store):
    """All files but those of one bucket are spoilt: its transcripts are read all the same, others are not."""
    path, segments, _ = store
    of = lambda f: int(f.name.split("_")[-1].split(".")[0])
    files = [f for f in Path(path, "runs").rglob("part-*.parquet")]
    assert len(files) == len({(f.parent.name, of(f)) for f in files}), "a bucket of a sample is one file"
    bucket = {r["transcript_id"]: r["b"] for r in segments.select("transcript_id", F.pmod(F.hash("transcript_id"), F.lit(8)).alias("b")).distinct().collect()}
    for f in files:
        if of(f) != bucket[7]:
            f.write_bytes(b"spoilt")
    runs = coverage_store.open_runs(spark, path)
    assert rows(coverage_store.track(runs, 7), *segments.columns) == rows(segments.where("transcript_id = 7"))
    assert rows(coverage_store.track(runs, 7, ["s1"]), "sample") == rows(segments.where("transcript_id = 7 AND sample = 's1'"), "sample")
    other = next(t for t, b in bucket.items() if b != bucket[7])
    with pytest.raises(Exception):
        coverage_store.track(runs, other).collect()


def test_store_problems(spark, store, tmp_path):
    path, segments, transcripts = store
    bad = spark.createDataFrame([("s", "odd", 1, 0, 2, 1), ("s", "txome_psite", 99, 0, 2, 1), ("s", "txome_psite", 1, 499, 501, 0), ("s", "txome_psite", 2, 0, 9, 1 << 31), ("s", "txome_psite", 2, 8, 9, 1), ("s", "txome_psite", 3, 4, 4, 1)], SEGMENT)
    assert rows(coverage_store.run_problems(bad, transcripts, locus.SIGNALS)) == sorted([(x, 1) for x in ("unknown signal", "unknown transcript", "segment off the transcript", "depth not positive", "depth over 32 bits", "segments overlap", "empty segment")], key=str)
    tx = spark.createDataFrame([(1, 10, 2, 11), (1, 10, 2, 5), (2, 0, None, None), (3, 5, 1, None)], "transcript_id long, transcript_len long, cds_start int, cds_end int")
    assert rows(coverage_store.transcript_problems(tx, 4, 30)) == sorted([("number of positions differs", 5), ("repeated transcript", 1), ("CDS off the transcript", 1), ("half a CDS", 1), ("empty transcript", 1)], key=str)
    # a wrong footer is told without reading data
    for f in Path(path, "runs").rglob("part-*.parquet"):
        f.write_bytes(b"spoilt")
    foot = spark.read.json(f"{path}/footer")
    foot.withColumn("layout", F.lit("coverage-runs/0")).write.json(str(tmp_path / "old" / "footer"))
    assert rows(coverage_store.problems(spark, str(tmp_path / "old"))) == [("layout is 'coverage-runs/0'", 1)]
    with pytest.raises(ValueError, match="coverage-runs/0"):
        coverage_store.open_runs(spark, str(tmp_path / "old"))
    foot.drop("trim").withColumn("assay", F.lit("x")).withColumn("provenance", F.lit("{")).write.json(str(tmp_path / "torn" / "footer"))
    assert rows(coverage_store.problems(spark, str(tmp_path / "torn"))) == sorted([("footer lacks trim", 1), ("unknown assay", 1), ("provenance is no JSON", 1)], key=str)


DUMP = "sample string, gene_id long, transcript_id long, read_id long, segment string"
LABELS = {s: s for s in genes.SEGMENTS}


def dump(spark, *extra):
    return spark.createDataFrame([("a", 1, 10, 1, "r7_txonly"), ("a", 1, 10, 2, "r7_txonly"), ("a", 1, 10, 3, "r7_gonly_multi"), ("a", 2, 20, 1, "r7_shared_unique"), ("b", 1, 10, 1, "r7_txonly"), *extra], DUMP)


def test_record_round_trip(spark, tmp_path):
    path, reads = str(tmp_path / "r"), dump(spark)
    found = partition_record.shares(partition_record.entries(reads, genes.SEGMENTS, ["sample"]), genes.SEGMENTS)
    partition_record.write(found, path, LABELS, {"unit": "read ids"}, reads)
    told = partition_record.meta(spark, path)
    assert [s["key"] for s in told["segments"]] == list(genes.SEGMENTS) and told["semantics"] == {"unit": "read ids"} and told["source"]["n_rows"] == 5
    back = partition_record.load(spark, path)
    assert rows(back, "sample", "gene_id", "n_union", "counts", "pct") == rows(found, "sample", "gene_id", "n_union", "counts", "pct")
    assert rows(partition_record.load(spark, path, [2]), "sample", "gene_id") == [("a", 2)]
    with pytest.raises(Exception, match="gene 77 is not in the record"):
        partition_record.load(spark, path, [1, 77]).collect()


def test_record_fails_inside_the_plan(spark, tmp_path):
    with pytest.raises(Exception, match="gene 1: a read is in the dump more than once"):
        partition_record.entries(dump(spark, ("a", 1, 10, 3, "r7_gonly_multi")), genes.SEGMENTS, ["sample"]).collect()
    with pytest.raises(Exception, match="gene 2: unknown segment odd"):
        partition_record.entries(dump(spark, ("a", 2, 20, 9, "odd")), genes.SEGMENTS, ["sample"]).collect()
    good = partition_record.entries(dump(spark), genes.SEGMENTS, ["sample"])
    with pytest.raises(Exception, match="counts sum to"):
        partition_record.shares(good.withColumn("n_union", F.col("n_union") + 1), genes.SEGMENTS).collect()
    with pytest.raises(Exception, match="segments "):
        partition_record.shares(good, [*genes.SEGMENTS, "more"]).collect()
    with pytest.raises(Exception):
        partition_record.from_text(spark.createDataFrame([("{",)], "json string"), genes.SEGMENTS).collect()
    path, reads = str(tmp_path / "r"), dump(spark)
    partition_record.write(partition_record.shares(good, genes.SEGMENTS), path, LABELS, {}, reads)
    for f in Path(path, "table").glob("*.csv"):
        f.with_name(f".{f.name}.crc").unlink()
        f.write_text(f.read_text().replace("\tr7_gonly_multi\tr7_gonly_multi\t1\t", "\tr7_gonly_multi\tr7_gonly_multi\t2\t"))
    with pytest.raises(Exception, match="counts sum to 4, union 3"):
        partition_record.load(spark, path).collect()
    spark.createDataFrame([("{}",)], "value string").coalesce(1).write.text(str(tmp_path / "empty" / "meta"))
    with pytest.raises(ValueError, match="no segments"):
        partition_record.load(spark, str(tmp_path / "empty"))


ALN = "sample string, read_id long, chrom string, pos long, epos long, strand string, qlen int, score int, nh int, is_secondary boolean"
EXON = "gene_id long, transcript_id long, chrom string, g_start long, g_end long, strand string, gene_type string"


def test_locus_artifact_and_its_faults(spark):
    exons = spark.createDataFrame([(1, 10, "c", 0, 10, "+", "protein_coding"), (1, 10, "c", 20, 30, "+", "protein_coding"), (1, 11, "c", 8, 15, "+", "protein_coding")], EXON)
    g = spark.createDataFrame([("s", 1, "c", 5, 9, "+", 4, 0, 1, False), ("s", 2, "c", 5, 9, "+", 4, 0, 1, False), ("s", 3, "c", 22, 26, "+", 4, 0, 2, False), ("s", 3, "c", 24, 28, "+", 4, 0, 2, True), ("s", 4, "c", 17, 22, "+", 5, 0, 1, False)], ALN)
    t = spark.createDataFrame([("s", 1, 10, 2), ("s", 3, 10, 9), ("s", 9, 10, 11), ("s", 8, 10, 40)], "sample string, read_id long, transcript_id long, pos long")
    sites = locus.locus_sites(g, t, exons, genes.selected_transcripts(exons), 3, 16)
    a = locus.locus_artifact(sites, exons, 16)
    r = a.collect()[0]
    assert [tuple(x) for x in r["exons"]] == [(0, 15), (20, 30)]
    assert [tuple(x) for x in r["layers"]] == [("genome", "genome_only", 5, 6, 1), ("genome", "shared_unique", 5, 6, 1), ("txome", "shared_multi", 22, 23, 1), ("txome", "shared_unique", 5, 6, 1), ("txome", "txome_only", 24, 25, 1)]
    assert [tuple(x) for x in r["tracks"]] == [("genome", "track", 5, 6, 2), ("txome", "track", 5, 6, 1), ("txome", "track", 22, 23, 1), ("txome", "track", 24, 25, 1)]
    c = r["counts"]
    assert (c["genome_shared_unique"], c["genome_shared_multi"], c["genome_genome_only"], c["txome_txome_only"], c["n_ambiguous"], c["n_unresolved"]) == (1, 1, 2, 2, 1, 1)
    assert locus.track_violations(a).count() == 0
    less = a.withColumn("layers", F.filter("layers", lambda x: x["layer"] != "genome_only"))
    assert rows(locus.track_violations(less), "route", "start", "end", "excess") == [("genome", 5, 6, -1)]
    deep = a.withColumn("tracks", F.transform("tracks", lambda x: F.struct(x["route"].alias("route"), x["layer"].alias("layer"), x["start"].alias("start"), (x["end"] + 6).alias("end"), x["depth"].alias("depth"))))
    assert ("genome", 10) in rows(locus.track_violations(deep).where("start IS NULL"), "route", "excess")


def test_footprints_over_junctions(spark):
    exons = spark.createDataFrame([(1, "c", 0, 10, "+"), (1, "c", 20, 30, "+"), (2, "c", 0, 10, "-"), (2, "c", 20, 30, "-"), (2, "c", 40, 43, "-")], "transcript_id long, chrom string, g_start long, g_end long, strand string")
    reads = spark.createDataFrame([("s", 1, 1, 8, 13), ("s", 2, 2, 1, 5), ("s", 3, 2, 11, 25), ("s", 4, 1, -3, 2), ("s", 5, 1, 20, 25), ("s", 6, 9, 0, 5)], "sample string, read_id long, transcript_id long, tpos long, tend long")
    for width in (3, 1024):
        blocks = locus.footprints_to_genome(reads, exons, width)
        assert rows(blocks, "read_id", "start", "end") == [(1, 20, 23), (1, 8, 10), (2, 28, 30), (2, 40, 42), (3, 0, 10), (3, 20, 22), (4, 0, 2)]
    assert rows(locus.projection_audit(reads, blocks), "n_reads", "n_whole", "n_cut", "n_over_junction", "n_unresolved") == [(6, 2, 2, 3, 2)]


def test_slice_sums_equal_bases(spark):
    import random

    rng, segments, depth = random.Random(5), [], {}
    for t in (1, 2):
        at = 0
        while at < 200:
            size, d = rng.randint(1, 9), rng.randint(0, 4)
            if d:
                segments.append(("s", t, at, at + size, d))
                depth |= {(t, b): d for b in range(at, at + size)}
            at += size
    slices = [(rng.randint(1, 3), str(k), rng.randint(-5, 150), rng.randint(-5, 220)) for k in range(60)]
    got = coverage.slice_sums(spark.createDataFrame(segments, "sample string, transcript_id long, start long, end long, depth long"), spark.createDataFrame(slices, "transcript_id long, label string, start long, end long"))
    want = [(t, k, sum(depth.get((t, b), 0) for b in range(a, e)) if a <= e else -sum(depth.get((t, b), 0) for b in range(e, a))) for t, k, a, e in slices if t < 3]
    assert rows(got, "transcript_id", "label", "total") == sorted(want, key=str)


def test_coverage_keys(spark):
    seg = lambda *x: spark.createDataFrame([("s", *r) for r in x], "sample string, transcript_id long, start long, end long, depth long")
    tx = spark.createDataFrame([(1, 10, 50), (2, 10, 50), (3, 10, 30), (4, None, None)], "transcript_id long, cds_start int, cds_end int")
    g, t = seg((1, 12, 13, 4), (3, 15, 20, 1), (4, 0, 5, 1)), seg((2, 0, 9, 1), (1, 30, 31, 1))
    read = lambda trimmed: rows(coverage.coverage_key(g, t, tx, 15, trimmed), "transcript_id", "interior", "eligible", "key_genome", "key_txome", "covered")
    assert read(False) == [(1, 10, True, True, True, True), (2, 10, True, False, False, False), (3, -10, False, True, False, False), (4, -30, False, False, False, False)]
    assert read(True) == [(1, 10, True, False, True, True), (2, 10, True, False, False, False), (3, -10, False, False, False, False), (4, -30, False, False, False, False)]


def test_tracks_are_maximal_runs_with_states(spark):
    segments = spark.createDataFrame([("s", "genome_psite", 1, 6, 7, 3), ("s", "txome_psite", 1, 0, 1, 2), ("s", "genome_footprint", 1, 3, 9, 1), ("s", "genome_footprint", 1, 9, 11, 1), ("s", "txome_footprint", 1, 0, 20, 2), ("s", "txome_psite", 2, 1, 2, 1)], SEGMENT)
    tx = spark.createDataFrame([(1, 2, 14), (2, 2, 5)], "transcript_id long, cds_start int, cds_end int")
    runs = locus.tracks(segments, tx, trim=2, width=4)
    assert rows(runs, "start", "end", *locus.SIGNALS) == [(2, 4, 0, 0, 1, 2), (4, 5, 3, 0, 1, 2), (5, 9, 0, 0, 1, 2), (9, 10, 0, 0, 0, 2)]
    s = locus.track_summary(runs, segments).collect()[0]
    assert (s["n_positions"], s["sum_genome_psite"], s["sum_txome_footprint"]) == (8, 3, 16) and [s[f"state_{x}"] for x in locus.SIGNALS] == ["covered", "outside_slice", "covered", "covered"]
    assert s["spearman_psite"] is None
