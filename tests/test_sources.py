"""Readers, sinks and locus operators on small files."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinroute.operators import categories, cohort, locus, qc, scan
from twinroute.sources import readers, sinks
from twinroute.streaming import increment, pending


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_sam_text(spark, tmp_path: Path):
    lines = ["@HD\tVN:1.6", "r1\t0\tchr1\t101\t255\t10M5N10M\t*\t0\t0\t" + "A" * 20 + "\t*\tNH:i:1\tAS:i:18", "r2\t272\tchr2\t1\t3\t3S17M\t*\t0\t0\t" + "A" * 20 + "\t*\tAS:i:-4\tNH:i:12", "r3\t4\t*\t0\t0\t*\t*\t0\t0\tA\t*"]
    (tmp_path / "lib_a.sam").write_text("\n".join(lines) + "\n")
    got = rows(scan.genome(readers.sam_text(spark, str(tmp_path / "*.sam"))), "sample", "read_id", "pos", "epos", "strand", "qlen", "nh", "score", "is_secondary")
    assert got == [("lib_a", "r1", 100, 125, "+", 20, 1, 18, False), ("lib_a", "r2", 0, 17, "-", 20, 12, -4, True)]


def test_gtf_and_headers(spark, tmp_path: Path):
    text = '#c\nchr1\tx\texon\t11\t20\t.\t+\t.\tgene_id "G1.2"; transcript_id "T1.1"; gene_type "lncRNA"; gene_name "n";\nchr1\tx\tCDS\t11\t19\t.\t-\t2\tgene_id "G1.2"; transcript_id "T2";\nchr1\tx\tstop_codon\t11\t13\t.\t-\t0\ttranscript_id "T2";\n'
    (tmp_path / "a.gtf").write_text(text)
    f = readers.gtf(spark, str(tmp_path / "a.gtf"), ("exon", "CDS", "stop_codon"))
    assert rows(f, "feature", "g_start", "g_end", "phase", "gene_id", "transcript_id", "gene_type") == [("CDS", 10, 19, 2, "G1.2", "T2", None), ("exon", 10, 20, None, "G1.2", "T1.1", "lncRNA"), ("stop_codon", 10, 13, 0, None, "T2", None)]
    assert rows(readers.stop_codon_transcripts(f), "transcript_id") == [("T2",)]
    lines = spark.createDataFrame([("T1.1|G1.2|a|b|tx|gene|100|UTR5:1-10|CDS:11-70|UTR3:71-100|\t100",), ("bad|header",), ("T2|G|a|b|t|g|xx|CDS:1-3|",)], "value string")
    good, bad = readers.headers(lines)
    assert rows(good, "base_id", "transcript_len", "utr5_start", "utr5_end", "cds_start", "cds_end", "utr3_end") == [("T1", 100, 0, 10, 10, 70, 100)] and bad.count() == 2


def test_bed_manifest_and_ids(spark, tmp_path: Path):
    (tmp_path / "r.bed").write_text("T1\t0\t10\tUTR5\t0\t+\nT1\t10\t20\todd\t0\t+\n")
    ok, bad = readers.regions_bed(spark, str(tmp_path / "r.bed"))
    assert ok.count() == 1 and bad.count() == 1
    (tmp_path / "full").write_text("x")
    (tmp_path / "none").write_text("")
    m = spark.createDataFrame([("1", "a", f"{tmp_path}/full"), ("2", "b", f"{tmp_path}/none"), ("1", "b", f"{tmp_path}/gone"), ("1", "", f"{tmp_path}/full")], "schema_version string, sample_id string, bam string")
    got = rows(readers.manifest_problems(m, readers.listing(spark, str(tmp_path)), ["bam"], "1"), "sample_id", "problem")
    assert got == sorted([("b", "schema version"), ("", "empty sample id"), ("b", "duplicate sample id"), ("b", "missing or empty bam"), ("b", "missing or empty bam")], key=str)
    known = spark.createDataFrame([("T1.1",), ("T2.1",), ("T2.2",)], "id string")
    found, refused = readers.resolve_ids(spark.createDataFrame([("T1",), ("T2.2",), ("T2",), ("T9.1",)], "asked string"), known)
    assert rows(found, "asked", "found") == [("T1", "T1.1"), ("T2.2", "T2.2")]
    assert rows(refused, "asked", "candidates") == [("T2", ["T2.1", "T2.2"]), ("T9.1", [])]


def test_sinks_and_increments(spark, tmp_path: Path):
    path = str(tmp_path / "t")
    increment(spark.createDataFrame([("a", 1), ("b", 2)], "sample string, n int"), path)
    increment(spark.createDataFrame([("b", 3)], "sample string, n int"), path)
    assert rows(spark.read.parquet(path), "sample", "n") == [("a", 1), ("b", 3)]
    done = spark.createDataFrame([("a", 1), ("b", 1)], "sample string, digest int")
    assert rows(pending(spark.createDataFrame([("a", 1), ("b", 2), ("c", 1)], "sample string, digest int"), done), "sample") == [("b",), ("c",)]
    pts = spark.createDataFrame([("s", "g", 1, 0, 2), ("s", "g", 1, 0, 1), ("s", "x", 1, 99, 1), ("s", "g", 7, 0, 0)], "sample string, signal string, transcript_id int, pos int, n int")
    tx = spark.createDataFrame([(1, 10)], "transcript_id int, transcript_len int")
    assert rows(sinks.coverage_violations(pts, tx, ["g"]), "signal", "problem", "n") == [("g", "count not positive", 1), ("g", "repeated position", 2), ("g", "unknown transcript", 1), ("x", "position out of range", 1), ("x", "unknown signal", 1)]
    one = sinks.provenance(spark, {"a": "b"}, {"p": "1"}, {"pts": pts}).collect()[0]
    assert one["tables"][0]["n"] == 4 and '"table":"pts"' in one["json"]
    sinks.write_tsv(pts, str(tmp_path / "o"), ["signal", "transcript_id", "n"], gz=False)
    assert readers.delimited(spark, str(tmp_path / "o"), ["sample", "n"]).count() == 4


def test_locus(spark):
    aln = spark.createDataFrame([("s", 1, "a", 10, 20, "+", 10, 0, 1, False), ("s", 2, "a", 12, 22, "+", 10, 0, 2, False), ("s", 2, "b", 90, 100, "+", 10, 0, 2, True), ("s", 3, "a", 10, 21, "+", 11, 0, 1, False), ("s", 4, "b", 10, 20, "+", 10, 0, 1, False)], "sample string, read_id long, chrom string, pos long, epos long, strand string, qlen int, score int, nh int, is_secondary boolean")
    members, audit = locus.locus_reads(aln, "a", 0, 50, spark.createDataFrame([("s", 10)], "sample string, qlen int"))
    assert rows(members, "read_id", "chrom") == [(1, "a"), (2, "a"), (2, "b")]
    assert rows(audit, "n_locus", "n_members", "n_other_length") == [(3, 2, 1)]
    layers = locus.read_layers(members, spark.createDataFrame([("s", 2)], "sample string, read_id long"))
    assert rows(layers, "read_id", "layer") == [(1, "genome_only_unique"), (2, "shared_multi")]
    sites, counted = locus.placed_once(members, "pos")
    assert rows(sites, "read_id", "site") == [(1, 10)] and rows(counted, "n_placed", "n_ambiguous", "n_unresolved") == [(1, 1, 0)]
    assert rows(locus.layer_coverage(sites, layers), "layer", "pos", "n") == [("genome_only_unique", 10, 1)]
    exons = spark.createDataFrame([(1, "a", 0, 10, "-"), (1, "a", 20, 30, "-"), (2, "a", 0, 15, "-"), (3, "a", 40, 60, "-"), (3, "a", 0, 5, "-")], "transcript_id int, chrom string, g_start long, g_end long, strand string")
    reads = spark.createDataFrame([("s", 1, 1, 0), ("s", 2, 1, 12), ("s", 3, 1, 20)], "sample string, read_id long, transcript_id int, tpos long")
    assert rows(locus.transcript_to_genome(reads, exons), "read_id", "gpos") == [(1, 29), (2, 7), (3, None)]
    blocks = spark.createDataFrame([("s", 1, "a", 41, 45), ("s", 2, "a", 12, 14), ("s", 3, "a", 50, 55)], "sample string, read_id long, chrom string, pos long, epos long")
    assert rows(locus.alternative_isoform(blocks, exons, 1), "transcript_id", "n_reads") == [(2, 1), (3, 2)]


def test_density_equals_a_dense_filter(spark):
    rng = np.random.default_rng(3)
    xy = rng.normal(size=(60, 2))
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(xy)], "k int, x double, y double")
    got = {r["k"]: r["density"] for r in locus.point_density(df, "x", "y", 20, 2.0).collect()}
    edges = [np.linspace(v.min(), v.max(), 21) for v in xy.T]
    at = [np.minimum(np.searchsorted(e, v, side="right") - 1, 19) for e, v in zip(edges, xy.T)]
    grid = np.zeros((20, 20))
    np.add.at(grid, tuple(at), 1)
    w = np.exp(-0.5 * (np.arange(-8, 9) / 2.0) ** 2)
    w /= w.sum()
    for axis in (0, 1):
        padded = np.pad(grid, [(8, 8) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        grid = np.apply_along_axis(lambda v: np.convolve(v, w, mode="valid"), axis, padded)
    assert max(abs(got[k] - grid[at[0][k], at[1][k]]) for k in got) < 1e-9


def test_tags_after_the_eighth_are_read(spark, tmp_path):
    line = "\t".join(["r1", "0", "chr1", "11", "60", "5M", "*", "0", "0", "ACGTA", "IIIII", *(f"X{k}:i:{k}" for k in range(9)), "NH:i:3", "AS:i:-7"])
    (tmp_path / "lib1.sam").write_text("@HD\tVN:1.6\n" + line + "\n" + "\t".join(line.split("\t")[:11]) + "\n")
    got = sorted(((r["nh"], r["score"], r["pos"], r["epos"], r["sample"]) for r in readers.sam_text(spark, str(tmp_path)).collect()), key=str)
    assert got == [(3, -7, 10, 15, "lib1"), (None, None, 10, 15, "lib1")]


def sam_line(name, flag, ref, pos, cigar, nh=None, score=None, mapq=60, n=10):
    tags = [f"NH:i:{nh}"] * (nh is not None) + [f"AS:i:{score}"] * (score is not None)
    return "\t".join([name, str(flag), ref, str(pos), str(mapq), cigar, "*", "0", "0", "A" * n, "*", *tags])


def test_scans_class_flags_and_resolve_references(spark, tmp_path):
    """A split read is one primary; supplementary and unmapped records never go on; blocks follow the CIGAR."""
    g = [sam_line("r1", 0, "chr1", 11, "4M2I4M5N2M", 1, 9, n=12), sam_line("r1", 2048, "chr2", 51, "5M", 1, 9), sam_line("r2", 16, "chr1", 5, "3M1D7M", 2, 5), sam_line("r2", 272, "chr1", 90, "10M", 2, 5), sam_line("r2", 2304, "chr3", 7, "4M", 2, 5), sam_line("r3", 4, "*", 0, "*")]
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "a.sam").write_text("@SQ\tSN:chr1\tLN:100\n" + "\n".join(g) + "\n")
    raw = readers.sam_text(spark, str(tmp_path / "g"))
    aln = scan.genome(raw)
    assert rows(aln, "read_id", "chrom", "pos", "is_secondary") == [("r1", "chr1", 10, False), ("r2", "chr1", 4, False), ("r2", "chr1", 89, True)]
    assert {r["read_id"]: [tuple(b) for b in r["blocks"]] for r in aln.where("NOT is_secondary").collect()} == {"r1": [(10, 18), (23, 25)], "r2": [(4, 7), (8, 15)]}
    assert rows(scan.audit(raw), "n_reads", "n_records", "n_unmapped", "n_supplementary", "n_secondary", "n_primary", "n_no_nh", "n_unique", "n_split_reads") == [(3, 6, 1, 2, 1, 2, 0, 1, 2)]
    t = [sam_line("r1", 0, "T1.2|G", 3, "10M", mapq=42), sam_line("r1", 2048, "T2.1|G", 3, "10M", mapq=42), sam_line("r2", 0, "T2.1|G", 95, "10M", mapq=10), sam_line("r4", 0, "phix", 1, "10M", mapq=60)]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.sam").write_text("@SQ\tSN:T1.2|G\tLN:50\n@SQ\tLN:100\tSN:T2.1|G\n@SQ\tSN:phix\tLN:9\n" + "\n".join(t) + "\n")
    known = spark.createDataFrame([("T1.1", 50), ("T2.1", 100)], "transcript_id string, transcript_len long")
    header = readers.sam_references(spark, str(tmp_path / "t"))
    here = scan.transcriptome(readers.sam_text(spark, str(tmp_path / "t")), scan.checked_references(header, known))
    assert rows(here, "read_id", "transcript_id", "pos", "confident") == [("r1", "T1.1", 2, True), ("r2", "T2.1", 94, False), ("r4", None, 0, True)]
    assert rows(scan.route_counts(here), "n_primary", "n_confident", "n_resolved", "n_used", "n_overhanging") == [(3, 2, 2, 1, 0)]
    assert rows(categories.taxonomy(aln, here), "n_universe", "n_sh_u", "n_sh_m", "n_to") == [(3, 1, 1, 1)]
    # the same through rows that still carry their flags
    assert rows(categories.taxonomy(raw.withColumn("is_secondary", F.col("flag").bitwiseAND(256) > 0), here), "n_sh_u", "n_sh_m", "n_to") == [(1, 1, 1)]


def test_scans_fail_with_all_that_is_wrong(spark):
    header = spark.createDataFrame([("T1.1|G", 51), ("T2.1|G", 100), ("T3|G", 7), ("other", 1)], "ref string, length long")
    known = spark.createDataFrame([("T1.1", 50), ("T2.1", 100), ("T3.1", 7), ("T3.2", 7)], "transcript_id string, transcript_len long")
    with pytest.raises(Exception, match="2 references do not fit.*T1.1.G: 51 instead of 50, T3.G: several transcripts"):
        scan.checked_references(header, known).collect()
    raw = spark.createDataFrame([("s", "r9", 0, "c", 1, 5, "+", 4, 60, None, 1, "4M")], readers.schemas.ALIGNMENT)
    with pytest.raises(Exception, match="without NH: r9"):
        scan.genome(raw).collect()
    assert scan.genome(raw.withColumn("flag", F.lit(256))).count() == 1


def test_manifest_paths_and_templates(spark, tmp_path: Path):
    (tmp_path / "a.bam").write_text("x")
    m = spark.createDataFrame([("1", "a", "", None), ("1", "b", " a.bam ", str(tmp_path / "a.bam")), ("1", "c", "gone.bam", "")], "schema_version string, sample_id string, bam string, rna string")
    roles = {"bam": "{sample}.bam", "rna": None}
    got = rows(readers.manifest_paths(m, roles, str(tmp_path)), "sample_id", "role", "path")
    at = lambda n: f"{tmp_path}/{n}"
    assert got == sorted([("a", "bam", at("a.bam")), ("a", "rna", None), ("b", "bam", at("a.bam")), ("b", "rna", at("a.bam")), ("c", "bam", at("gone.bam")), ("c", "rna", None)], key=str)
    found = rows(readers.manifest_problems(m, readers.listing(spark, str(tmp_path)), roles, "1", str(tmp_path)), "sample_id", "problem")
    assert found == [("a", "no rna"), ("c", "missing or empty bam"), ("c", "no rna")]


def test_refusals_name_all_that_is_wrong(spark):
    master = spark.createDataFrame([("a", 28, "True", 12), ("a", 29, "0", 12), ("b", 28, "false", 12)], "sample string, read_length int, in_phase1 string, psite_offset int")
    asked = lambda *x: spark.createDataFrame([(s,) for s in x], "sample string")
    assert rows(qc.selected_lengths(master, asked("a")), "sample", "read_length", "psite_offset") == [("a", 28, 12)]
    with pytest.raises(Exception, match="samples without read lengths: 2 .b has no selected length, c is absent"):
        qc.selected_lengths(master, asked("a", "b", "c")).collect()
    with pytest.raises(Exception, match="without read lengths"):
        qc.selected_lengths(master, asked("c")).count()
    scored = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("z", 2.0)], "k string, score double")
    assert cohort.without_ties(scored.where("k <> 'z'")).count() == 2
    with pytest.raises(Exception, match="tied scores: 1 .2.0"):
        cohort.without_ties(scored).collect()
    names = spark.createDataFrame([("x", "n1"), ("y", "n1"), ("z", "n2")], "k string, name string")
    one = scored.where("k IN ('x', 'z')").withColumn("score", F.col("score") + 0.04)
    assert rows(cohort.panel_table(one, names, "k", ["name"], {"score": 1}), "k", "score", "name") == [("x", 1.0, "n1"), ("z", 2.0, "n2")]
    with pytest.raises(Exception, match="repeated name: 1 .n1"):
        cohort.panel_table(scored, names, "k", ["name"], {}).collect()
    with pytest.raises(Exception, match="no metadata: 1 .y"):
        cohort.panel_table(scored, names.where("k <> 'y'"), "k", [], {}).collect()


def test_consensus_checksums_and_master(spark, tmp_path: Path):
    import hashlib

    (tmp_path / "c.gtf").write_text('chr1\tx\tgene\t1\t9\t.\t+\t.\tgene_id "P1"; parent_id "G1";\nchr1\tx\tgene\t11\t19\t.\t+\t.\tgene_id "P2";\n')
    good, bad = readers.consensus_pseudogenes(spark, str(tmp_path / "c.gtf"))
    assert rows(good, "gene_id", "parent_id", "g_start") == [("P1", "G1", 0)] and rows(bad, "gene_id") == [("P2",)]
    found = readers.checksums(spark, str(tmp_path / "c.gtf")).collect()[0]
    assert found["sha256"] == hashlib.sha256((tmp_path / "c.gtf").read_bytes()).hexdigest() and found["length"] == (tmp_path / "c.gtf").stat().st_size
    names = readers.schemas.QC_MASTER.fieldNames()
    (tmp_path / "q.csv").write_text(",".join(names) + "\n" + ",".join(["s", "28", "10", "50.0", "true", "12", "60.1", "", "20.0", "false", "9", "5", "2", "2"]) + "\n")
    master = readers.qc_master(spark, str(tmp_path / "q.csv"))
    assert rows(master, "sample", "psite_offset", "frame1_pct", "periodic") == [("s", 12, None, False)]
    assert rows(qc.selected_lengths(master, master.select("sample")), "read_length", "psite_offset") == [(28, 12)]


def test_cluster_quality_rises_with_the_right_k(spark):
    from twinroute.operators import cluster

    data = [(k, *((1.0, 0.0) if k % 3 == 0 else (0.0, 1.0) if k % 3 == 1 else (0.5, 0.5))) for k in range(60)]
    q = {r["k"]: r for r in cluster.quality(spark.createDataFrame(data, "g int, f_a double, f_b double"), ["a", "b"], range(2, 4)).collect()}
    assert q[3]["within"] < 1e-9 < q[2]["within"] and abs(q[3]["between_share"] - 1) < 1e-9 and q[3]["silhouette"] > 0.99
