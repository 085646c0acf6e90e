"""Queries over scans, projections, slices, tracks and coordinate checks, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinroute.functions import columns as c
from twinroute.operators import alignments, annotate, categories, cohort, coords, counts, coverage, genes, intervals, locus, qc, scan
from twinroute.plans import position_queries as pq
from twinroute.plans import read_queries
from twinroute.plans.read_queries import CELLS_SQL, OMIT_SQL, PARTITION_SQL, SELECTED_SQL, TAXONOMY_SQL, TIED_SQL, WIDTH, inputs, partition, rounded
from twinroute.plans.views import cte, stored, table, view
from twinroute.sources import partition_record

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Bin width on the spliced axis of the test tables.
AXIS = 32
TRIM = 15


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


# ---- scans: raw records with flags derived from the views; the same text in both engines

_FLAG_G = "CASE WHEN strand = '-' THEN 16 ELSE 0 END + CASE WHEN is_secondary THEN 256 ELSE 0 END + CASE WHEN is_secondary AND pos % 7 = 3 THEN 2048 ELSE 0 END + CASE WHEN pos % 89 = 0 THEN 4 ELSE 0 END"
_FLAG_T = "CASE WHEN read_id % 13 = 5 THEN 2048 WHEN read_id % 17 = 3 THEN 256 WHEN read_id % 19 = 2 THEN 4 ELSE 0 END"
_REF_T = "CASE WHEN transcript_id % 10 = 9 THEN 'other' ELSE concat('T', transcript_id, '.1|G|') END"
RAW_SQL = f""",
raw_g AS (SELECT sample, read_id, {_FLAG_G} AS flag, chrom, pos, CASE WHEN read_id % 3 = 0 THEN epos + 50 ELSE epos END AS epos, strand, qlen, score, CASE WHEN is_secondary AND pos % 5 = 0 THEN NULL ELSE nh END AS nh, is_secondary, CASE WHEN read_id % 3 = 0 THEN epos - 8 ELSE epos END AS cut FROM aln_g),
raw_t AS (SELECT *, {_FLAG_T} AS flag FROM aln_t)"""
SCANNED_SQL = """,
g AS (SELECT sample, read_id, CASE WHEN min(nh) = 1 THEN 'unique' ELSE 'multi' END AS genome FROM raw_g WHERE flag & 2308 = 0 GROUP BY 1, 2),
t AS (SELECT DISTINCT sample, read_id, true AS there FROM raw_t WHERE flag & 2308 = 0)"""
SCANNED_CELLS_SQL = RAW_SQL + SCANNED_SQL + CELLS_SQL[CELLS_SQL.index(",\ncells AS") :]


def raw_genome(spark, d):
    spliced = F.col("read_id") % 3 == 0
    aln = view(spark, d, "aln_g").withColumn("flag", F.expr(_FLAG_G))
    return aln.select(
        "sample", "read_id", "flag", F.col("chrom").alias("ref"), "pos", F.when(spliced, F.col("epos") + 50).otherwise(F.col("epos")).alias("epos"), "strand", "qlen", F.lit(60).alias("mapq"),
        F.expr("CASE WHEN is_secondary AND pos % 5 = 0 THEN NULL ELSE nh END").alias("nh"), "score", F.expr("case when read_id % 3 = 0 then concat(qlen - 8, 'M50N8M') else concat(qlen, 'M') end").alias("cigar"),
    )


def raw_transcriptome(spark, d):
    return view(spark, d, "aln_t").select("sample", "read_id", F.expr(_FLAG_T).alias("flag"), F.expr(_REF_T).alias("ref"), "pos", (F.col("pos") + F.col("qlen")).alias("epos"), "qlen", "mapq")


def scanned(spark, d):
    """Rows of both routes as scans give them; references are checked against the exons' transcripts."""
    known = coords.transcript_table(view(spark, d, "exons")).select(F.concat(F.lit("T"), "transcript_id", F.lit(".7")).alias("transcript_id"), "transcript_len")
    header = known.select(F.concat(F.split("transcript_id", "[.]")[0], F.lit(".1|G|")).alias("ref"), F.col("transcript_len").alias("length"))
    return scan.genome(raw_genome(spark, d)), scan.transcriptome(raw_transcriptome(spark, d), scan.checked_references(header, known))


_KINDS = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in scan.KINDS)
_SUMS = ", ".join(f"CAST(sum({x}) AS BIGINT) AS {x}" for x in ("n_records", *(f"n_{k}" for k in scan.KINDS), "n_no_nh", "n_unique"))


@query(
    "scan_audit",
    cte("aln_g", "aln_t") + RAW_SQL + f""", k AS (SELECT *, CASE WHEN flag & 4 <> 0 THEN 'unmapped' WHEN flag & 2048 <> 0 THEN 'supplementary' WHEN flag & 256 <> 0 THEN 'secondary' ELSE 'primary' END AS kind FROM raw_g),
p AS (SELECT sample, read_id, count(*) AS n_records, {_KINDS}, count(*) FILTER (WHERE kind = 'primary' AND nh IS NULL) AS n_no_nh, count(*) FILTER (WHERE kind = 'primary' AND nh = 1) AS n_unique FROM k GROUP BY 1, 2)
SELECT sample, count(*) AS n_reads, {_SUMS}, count(*) FILTER (WHERE n_supplementary > 0) AS n_split_reads, count(*) FILTER (WHERE n_primary > 1) AS n_repeated_primaries FROM p GROUP BY 1""",
)
def scan_audit(spark, d):
    return scan.audit(raw_genome(spark, d))


@query("scanned_taxonomy", cte("aln_g", "aln_t") + SCANNED_CELLS_SQL + TAXONOMY_SQL[len(CELLS_SQL) :] + " SELECT * FROM taxonomy")
def scanned_taxonomy(spark, d):
    return categories.taxonomy(*scanned(spark, d))


@query(
    "route_scan",
    cte("aln_g", "aln_t", "exons") + RAW_SQL + """, tx AS (SELECT transcript_id, sum(g_end - g_start) AS len FROM exons GROUP BY 1), r AS (SELECT a.*, len FROM raw_t a LEFT JOIN tx ON tx.transcript_id = a.transcript_id AND a.transcript_id % 10 <> 9 WHERE flag & 2308 = 0)
SELECT sample, count(*) AS n_primary, count(*) FILTER (WHERE mapq >= 42) AS n_confident, count(len) AS n_resolved, count(*) FILTER (WHERE len IS NOT NULL AND mapq >= 42) AS n_used, count(*) FILTER (WHERE mapq >= 42 AND pos + qlen > len) AS n_overhanging FROM r GROUP BY 1""",
)
def route_scan(spark, d):
    return scan.route_counts(scanned(spark, d)[1])


# a third of the reads has two blocks with a gap of 50 bases
SPLICED_SQL = """,
gou AS (SELECT a.*, read_id % 3 = 0 AS spliced FROM raw_g a JOIN cells USING (sample, read_id) WHERE flag & 2308 = 0 AND cell = 'go_u'),
hit AS (SELECT a.sample, a.read_id, min((CASE WHEN gene_type = 'protein_coding' AND s.transcript_id IS NOT NULL THEN 0 WHEN gene_type = 'protein_coding' THEN 1 WHEN contains(gene_type, 'pseudogene') THEN 2 ELSE 3 END, e.gene_id, s.transcript_id)) AS b
  FROM gou a JOIN exons e ON a.chrom = e.chrom AND e.g_start < a.epos AND a.pos < e.g_end LEFT JOIN selected s ON s.gene_id = e.gene_id GROUP BY 1, 2),
bdy AS (SELECT gene_id, chrom, min(g_start) AS b_start, max(g_end) AS b_end FROM exons GROUP BY 1, 2),
xr AS (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY g_start, g_end) AS x FROM exons),
fit AS (SELECT a.*, b, (SELECT min(x) FROM xr WHERE xr.transcript_id = b[3] AND xr.chrom = a.chrom AND xr.strand = a.strand AND g_start <= pos AND cut <= g_end) AS x1, (SELECT min(x) FROM xr WHERE xr.transcript_id = b[3] AND xr.chrom = a.chrom AND xr.strand = a.strand AND g_start <= cut + 50 AND a.epos <= g_end) AS x2
  FROM gou a LEFT JOIN hit h ON h.sample = a.sample AND h.read_id = a.read_id),
lab AS (SELECT a.sample, a.read_id, CASE WHEN b[1] = 0 THEN CASE WHEN x1 IS NULL OR (spliced AND x2 IS NULL) THEN 'nonselected_isoform_exon' WHEN NOT spliced OR x2 - x1 = 1 THEN 'representable_not_present_in_dedup_bam' ELSE 'splice_junction_absent' END
    WHEN b[1] = 1 THEN 'protein_coding_gene_omitted' WHEN b[1] = 2 THEN 'pseudogene' WHEN b[1] = 3 THEN 'non_protein_coding_gene'
    WHEN EXISTS (SELECT 1 FROM bdy WHERE bdy.chrom = a.chrom AND b_start < a.epos AND a.pos < b_end) THEN 'intronic' ELSE 'intergenic' END AS label,
  EXISTS (SELECT 1 FROM om WHERE om.chrom = a.chrom AND ((om."start" < cut AND a.pos < om."end") OR (spliced AND om."start" < a.epos AND cut + 50 < om."end"))) AS on_omitted FROM fit a)"""


@query("spliced_reach", cte("aln_g", "aln_t", "exons") + SCANNED_CELLS_SQL + SELECTED_SQL + OMIT_SQL + SPLICED_SQL + " SELECT sample, read_id, label, on_omitted FROM lab")
def spliced_reach(spark, d):
    g, t = scanned(spark, d)
    exons = view(spark, d, "exons")
    return categories.reach_labels(categories.genome_only_unique(g, t), exons, genes.selected_transcripts(exons), WIDTH)


# ---- footprints on the genome

PROJECTED_SQL = pq.ORDER_SQL + """,
fr AS (SELECT sample, read_id, transcript_id, pos AS tpos, pos + qlen AS tend FROM aln_t),
fo AS (SELECT fr.*, chrom, strand, g_start, g_end, greatest(tpos, tx_start) - tx_start AS a, least(tend, tx_end) - tx_start AS b FROM fr JOIN xe ON xe.transcript_id = fr.transcript_id AND tx_start < tend AND tpos < tx_end),
fb AS (SELECT sample, read_id, transcript_id, chrom, CASE WHEN strand = '-' THEN g_end - b ELSE g_start + a END AS s, CASE WHEN strand = '-' THEN g_end - a ELSE g_start + b END AS e FROM fo)"""


def footprint_reads(spark, d):
    return view(spark, d, "aln_t").select("sample", "read_id", "transcript_id", F.col("pos").alias("tpos"), (F.col("pos") + F.col("qlen")).alias("tend"))


@query(
    "projected_footprints",
    cte("aln_t", "exons") + PROJECTED_SQL + """, k AS (SELECT sample, chrom, p, count(*) AS depth FROM (SELECT sample, chrom, unnest(range(s, e)) AS p FROM fb) GROUP BY 1, 2, 3), i AS (SELECT *, p - row_number() OVER (PARTITION BY sample, chrom, depth ORDER BY p) AS isl FROM k)
SELECT sample, chrom, min(p) AS "start", max(p) + 1 AS "end", depth FROM i GROUP BY sample, chrom, depth, isl""",
)
def projected_footprints(spark, d):
    blocks = locus.footprints_to_genome(footprint_reads(spark, d), view(spark, d, "exons"), AXIS)
    return intervals.depth(blocks, ["sample", "chrom"], width=4096)


@query(
    "projection_audit",
    cte("aln_t", "exons") + PROJECTED_SQL + """, c AS (SELECT sample, read_id, transcript_id, count(*) AS k, sum(e - s) AS n FROM fb GROUP BY 1, 2, 3)
SELECT fr.sample, count(*) AS n_reads, count(*) FILTER (WHERE n = tend - tpos) AS n_whole, count(*) FILTER (WHERE n < tend - tpos) AS n_cut, count(*) FILTER (WHERE k > 1) AS n_over_junction, count(*) FILTER (WHERE n IS NULL) AS n_unresolved
FROM fr LEFT JOIN c USING (sample, read_id, transcript_id) GROUP BY 1""",
)
def projection_audit(spark, d):
    reads = footprint_reads(spark, d)
    return locus.projection_audit(reads, locus.footprints_to_genome(reads, view(spark, d, "exons"), AXIS))


# ---- four signals on the spliced axis

SIGNALS_SQL = pq.ROUTES_SQL + """,
gf AS (SELECT fh.sample, fh.transcript_id, xe.tx_start + CASE WHEN fh.strand = '-' THEN fh.g_end - least(epos, fh.g_end) ELSE greatest(p.pos, fh.g_start) - fh.g_start END AS s, least(epos, fh.g_end) - greatest(p.pos, fh.g_start) AS n
  FROM fh JOIN prim p ON p.sample = fh.sample AND p.read_id = fh.read_id JOIN xe ON xe.transcript_id = fh.transcript_id AND xe.g_start = fh.g_start),
gfb AS (SELECT sample, transcript_id, p AS pos, count(*) AS n FROM (SELECT sample, transcript_id, unnest(range(s, s + n)) AS p FROM gf) GROUP BY 1, 2, 3),
tfb AS (SELECT sample, transcript_id, p AS pos, count(*) AS n FROM (SELECT a.sample, a.transcript_id, unnest(range(a.pos, least(a.pos + a.qlen, transcript_len))) AS p FROM aln_t a JOIN tx ON tx.transcript_id = a.transcript_id) GROUP BY 1, 2, 3)"""


def route_segments(spark, d):
    """(sample, signal, transcript_id, start, end, depth) of all four signals."""
    aln_t, exons = inputs(spark, d, "aln_t", "exons")
    key = ["sample", "transcript_id"]
    lengths = coords.transcript_table(exons).select("transcript_id", "transcript_len")
    aln = alignments.with_five_prime(view(spark, d, "aln_g", by_read=True).where("NOT is_secondary")).select("sample", "read_id", "chrom", "strand", "p5", "pos", "epos")
    first = coverage.to_transcript(coverage.first_hits(aln, exons, width=WIDTH), exons)
    # tpos is the five-prime base; the footprint reaches from it to the read's end or the exon's
    back = F.col("strand") == "-"
    lead = F.when(back, F.col("p5") - F.least("epos", "g_end") + 1).otherwise(F.greatest("pos", "g_start") - F.col("p5"))
    g_fp = first.select(*key, (F.col("tpos") + lead).alias("start"), (F.col("tpos") + lead + F.least("epos", "g_end") - F.greatest("pos", "g_start")).alias("end"))
    t = aln_t.join(lengths, "transcript_id").where("pos < transcript_len")
    t_fp = t.select(*key, F.col("pos").alias("start"), c.clamp(F.col("pos") + F.col("qlen"), F.col("transcript_len")).alias("end"))
    parts = {
        "genome_psite": coverage.as_segments(coverage.point_coverage(first, key, "tpos")),
        "txome_psite": coverage.as_segments(coverage.point_coverage(t, key, "pos")),
        "genome_footprint": intervals.depth(g_fp, key, width=AXIS),
        "txome_footprint": intervals.depth(t_fp, key, width=AXIS),
    }
    out = None
    for name, df in parts.items():
        one = df.select("sample", F.lit(name).alias("signal"), "transcript_id", "start", "end", "depth")
        out = one if out is None else out.unionByName(one)
    return out


def of_signal(segments, name):
    return segments.where(F.col("signal") == name).drop("signal")


def key_sql(g: str, gn: str, t: str, tn: str, trim: int) -> str:
    inside = f"pos >= coalesce(cds_start, 0) + {trim} AND pos < coalesce(cds_end, 0) - {trim}"
    return f""", u AS (SELECT sample, transcript_id, pos, {gn} AS g, 0 AS t FROM {g} UNION ALL SELECT sample, transcript_id, pos, 0, {tn} FROM {t}),
k AS (SELECT sample, transcript_id, max(coalesce(cds_end, 0) - coalesce(cds_start, 0)) - {2 * TRIM} AS interior, coalesce(sum(g) FILTER (WHERE {inside}), 0) > 0 AS key_genome, coalesce(sum(t) FILTER (WHERE {inside}), 0) > 0 AS key_txome FROM u JOIN txc USING (transcript_id) GROUP BY 1, 2)
SELECT sample, transcript_id, CAST(interior AS BIGINT) AS interior, interior > 0 AS eligible, key_genome, key_txome, interior > 0 AND (key_genome OR key_txome) AS covered FROM k"""


def bounded(spark, d):
    return pq.with_cds(coords.transcript_table(view(spark, d, "exons")))


@query("coverage_key_psite", cte("aln_g", "aln_t", "exons") + SIGNALS_SQL + key_sql("gp", "g", "tp", "t", 0))
def coverage_key_psite(spark, d):
    found = route_segments(spark, d)
    return coverage.coverage_key(of_signal(found, "genome_psite"), of_signal(found, "txome_psite"), bounded(spark, d), TRIM, trimmed=False)


@query("coverage_key_footprint", cte("aln_g", "aln_t", "exons") + SIGNALS_SQL + key_sql("gfb", "n", "tfb", "n", TRIM))
def coverage_key_footprint(spark, d):
    found = route_segments(spark, d)
    return coverage.coverage_key(of_signal(found, "genome_footprint"), of_signal(found, "txome_footprint"), bounded(spark, d), TRIM, trimmed=True)


@query(
    "footprint_region_sums",
    cte("aln_g", "aln_t", "exons") + SIGNALS_SQL + """, reg AS (SELECT transcript_id, 'UTR5' AS label, 0 AS s, cds_start AS e FROM txc WHERE cds_start IS NOT NULL UNION ALL SELECT transcript_id, 'CDS', cds_start, CASE WHEN has_stop THEN cds_end - 3 ELSE cds_end END FROM txc WHERE cds_start IS NOT NULL
  UNION ALL SELECT transcript_id, 'UTR3', CASE WHEN has_stop THEN cds_end - 3 ELSE cds_end END, transcript_len FROM txc WHERE cds_start IS NOT NULL)
SELECT sample, transcript_id, label, CAST(coalesce(sum(n) FILTER (WHERE s <= pos AND pos < e), 0) AS BIGINT) AS total FROM tfb JOIN reg USING (transcript_id) WHERE s < e GROUP BY 1, 2, 3""",
)
def footprint_region_sums(spark, d):
    return coverage.slice_sums(of_signal(route_segments(spark, d), "txome_footprint"), coords.normalized_regions(bounded(spark, d)))


TRACKS_SQL = SIGNALS_SQL + f""",
sg AS (SELECT sample, 'genome_psite' AS signal, transcript_id, pos, g AS n FROM gp UNION ALL SELECT sample, 'txome_psite', transcript_id, pos, t FROM tp UNION ALL SELECT sample, 'genome_footprint', transcript_id, pos, n FROM gfb UNION ALL SELECT sample, 'txome_footprint', transcript_id, pos, n FROM tfb),
ax AS (SELECT sample, transcript_id, cds_start, unnest(range(cds_start + {TRIM}, cds_end - {TRIM})) AS pos FROM (SELECT DISTINCT sample, transcript_id FROM sg) JOIN txc USING (transcript_id) WHERE cds_end - cds_start > {2 * TRIM}),
gr AS (SELECT ax.sample, ax.transcript_id, ax.pos - cds_start AS x, """ + ", ".join(f"coalesce(sum(n) FILTER (WHERE signal = '{s}'), 0) AS {s}" for s in locus.SIGNALS) + """ FROM ax LEFT JOIN sg ON sg.sample = ax.sample AND sg.transcript_id = ax.transcript_id AND sg.pos = ax.pos GROUP BY 1, 2, 3)"""


@query(
    "coverage_tracks",
    cte("aln_g", "aln_t", "exons") + TRACKS_SQL + """, m AS (SELECT *, CASE WHEN ({v}) IS DISTINCT FROM lag(({v})) OVER (PARTITION BY sample, transcript_id ORDER BY x) THEN 1 ELSE 0 END AS new FROM gr), i AS (SELECT *, sum(new) OVER (PARTITION BY sample, transcript_id ORDER BY x) AS run FROM m)
SELECT sample, transcript_id, CAST(min(x) AS BIGINT) AS "start", CAST(max(x) + 1 AS BIGINT) AS "end", {c} FROM i GROUP BY sample, transcript_id, run""".format(v=", ".join(locus.SIGNALS), c=", ".join(f"CAST(max({s}) AS BIGINT) AS {s}" for s in locus.SIGNALS)),
)
def coverage_tracks(spark, d):
    return locus.tracks(route_segments(spark, d), bounded(spark, d), TRIM, AXIS)


def _corr(kind: str) -> str:
    return pq.corr_sql(f"(SELECT sample, transcript_id, genome_{kind} AS g, txome_{kind} AS t FROM gr)", "sample, transcript_id", "true")


@query(
    "track_summary",
    cte("aln_g", "aln_t", "exons") + TRACKS_SQL + ", ev AS (SELECT sample, transcript_id, " + ", ".join(f"coalesce(sum(n) FILTER (WHERE signal = '{s}'), 0) AS n_{s}" for s in locus.SIGNALS) + " FROM sg GROUP BY 1, 2), su AS (SELECT sample, transcript_id, count(*) AS n_positions, "
    + ", ".join(f"CAST(sum({s}) AS BIGINT) AS sum_{s}" for s in locus.SIGNALS) + " FROM gr GROUP BY 1, 2) SELECT su.*, " + ", ".join(f"CASE WHEN n_{s} = 0 THEN 'no_reads' WHEN sum_{s} = 0 THEN 'outside_slice' ELSE 'covered' END AS state_{s}" for s in locus.SIGNALS)
    + ", p.spearman AS spearman_psite, p.pearson AS pearson_psite, f.spearman AS spearman_footprint, f.pearson AS pearson_footprint FROM su JOIN ev USING (sample, transcript_id) JOIN " + _corr("psite") + " p USING (sample, transcript_id) JOIN " + _corr("footprint") + " f USING (sample, transcript_id)",
)
def track_summary(spark, d):
    found = route_segments(spark, d)
    out = locus.track_summary(locus.tracks(found, bounded(spark, d), TRIM, AXIS), found)
    return rounded(out, *(f"{x}_{k}" for k in ("psite", "footprint") for x in ("spearman", "pearson")), places=6)


# ---- the coordinate against all that has to agree with it, with a fault in every fiftieth transcript

PLANTED_SQL = pq.TX_SQL + """,
sp AS (SELECT transcript_id, CASE WHEN transcript_id % 50 = 9 AND exon_index = 0 THEN 'chrX' ELSE chrom END AS chrom, CASE WHEN transcript_id % 50 = 8 AND exon_index = 0 THEN '?' ELSE strand END AS strand, g_start, g_end, CASE WHEN transcript_id % 50 = 1 AND exon_index = 1 THEN tx_start + 1 ELSE tx_start END AS tx_start, tx_end FROM xe),
dl AS (SELECT transcript_id, CASE WHEN transcript_id % 50 = 2 THEN transcript_len + 1 ELSE transcript_len END AS declared_len FROM tx WHERE transcript_id % 50 <> 3 UNION ALL SELECT 1000000, 10),
rg AS (SELECT transcript_id, cds_start AS s, CASE WHEN transcript_id % 50 = 6 THEN transcript_len + 5 ELSE cds_end END AS e FROM txc WHERE cds_start IS NOT NULL AND transcript_id % 50 <> 4 UNION ALL SELECT transcript_id, cds_start, cds_start + 3 FROM txc WHERE cds_start IS NOT NULL AND transcript_id % 50 = 5),
gc AS (SELECT transcript_id, sum(least(cds_end, tx_end) - greatest(cds_start, tx_start)) - CASE WHEN transcript_id % 50 = 7 THEN 1 ELSE 0 END AS n FROM xe JOIN txc USING (transcript_id) WHERE cds_start < tx_end AND tx_start < cds_end GROUP BY 1),
ch AS (SELECT *, lag(tx_end) OVER w AS before, lag(g_start) OVER w AS pg, lag(g_end) OVER w AS pe FROM sp WINDOW w AS (PARTITION BY transcript_id ORDER BY tx_start, tx_end)),
x AS (SELECT transcript_id, bool_or(tx_start <> coalesce(before, 0)) AS gaps, bool_or(tx_end - tx_start <> g_end - g_start) AS stretched, bool_or(coalesce(CASE WHEN strand = '-' THEN g_end > pg ELSE pe > g_start END, false)) AS disordered, count(DISTINCT chrom) AS chroms, count(DISTINCT strand) AS strands, bool_or(strand NOT IN ('+', '-')) AS odd, max(tx_end) AS len FROM ch GROUP BY 1),
r AS (SELECT transcript_id, count(*) AS k, min(s) AS s, max(e) AS e, sum(e - s) AS n FROM rg GROUP BY 1),
j AS (SELECT coalesce(x.transcript_id, dl.transcript_id) AS transcript_id, x.* EXCLUDE (transcript_id), declared_len, coalesce(k, 0) AS k, s, e, r.n AS cds_n, coalesce(gc.n, 0) AS gen_n, x.transcript_id IS NULL AS unknown FROM x FULL JOIN dl ON dl.transcript_id = x.transcript_id LEFT JOIN r ON r.transcript_id = x.transcript_id LEFT JOIN gc ON gc.transcript_id = x.transcript_id)"""
_TESTS = {
    "unknown_transcript": "unknown", "several_chromosomes": "chroms > 1", "several_strands": "strands > 1 OR odd", "axis_not_contiguous": "gaps", "exon_length_differs": "stretched", "exons_out_of_order": "disordered",
    "no_declared_length": "declared_len IS NULL", "declared_length_differs": "len <> declared_len", "no_cds": "k = 0", "several_cds": "k > 1", "cds_off_the_transcript": "s < 0 OR e > len OR s >= e", "genomic_cds_length_differs": "k = 1 AND cds_n <> gen_n",
}


@query("spliced_violations", cte("exons") + PLANTED_SQL + " " + " UNION ALL ".join(f"SELECT transcript_id, '{name}' AS problem FROM j WHERE {when}" for name, when in _TESTS.items()))
def spliced_violations(spark, d):
    exons = view(spark, d, "exons")
    t, known = F.col("transcript_id") % 50, bounded(spark, d)
    ordered = coords.exon_order(exons)
    first = F.col("exon_index") == 0
    spliced = ordered.withColumn("chrom", F.when((t == 9) & first, "chrX").otherwise(F.col("chrom"))).withColumn("strand", F.when((t == 8) & first, "?").otherwise(F.col("strand")))
    spliced = spliced.withColumn("tx_start", F.when((t == 1) & (F.col("exon_index") == 1), F.col("tx_start") + 1).otherwise(F.col("tx_start")))
    declared = known.where(t != 3).select("transcript_id", F.when(t == 2, F.col("transcript_len") + 1).otherwise(F.col("transcript_len")).alias("declared_len"))
    declared = declared.unionByName(spark.range(1).select(F.lit(1_000_000).cast("long").alias("transcript_id"), F.lit(10).cast("long").alias("declared_len")))
    coding = known.where("cds_start IS NOT NULL").withColumn("label", F.lit("CDS"))
    regions = coding.where(t != 4).select("transcript_id", "label", F.col("cds_start").alias("start"), F.when(t == 6, F.col("transcript_len") + 5).otherwise(F.col("cds_end")).alias("end"))
    regions = regions.unionByName(coding.where(t == 5).select("transcript_id", "label", F.col("cds_start").alias("start"), (F.col("cds_start") + 3).alias("end")))
    spans = coding.select(F.lit("").alias("sample"), F.lit(0).alias("read_id"), "transcript_id", F.col("cds_start").alias("tpos"), F.col("cds_end").alias("tend"))
    cds = locus.footprints_to_genome(spans, exons, AXIS).select("transcript_id", F.col("start").alias("g_start"), F.col("end").alias("g_end"))
    # one base short
    short = coding.where(t == 7).select("transcript_id", F.lit(1).alias("g_start"), F.lit(0).alias("g_end"))
    return coords.spliced_violations(spliced, declared, regions, cds.unionByName(short))


# ---- loci of all genes, and the partition's record

LOCUS_SQL = CELLS_SQL + TIED_SQL + SELECTED_SQL + pq.ORDER_SQL + """,
span AS (SELECT gene_id, min(chrom) AS chrom, min(g_start) AS gs, max(g_end) AS ge FROM exons GROUP BY 1 HAVING count(DISTINCT chrom) = 1),
gm AS (SELECT span.gene_id, sample, read_id, CASE WHEN strand = '-' THEN epos - 1 ELSE pos END AS p5 FROM best JOIN span ON best.chrom = span.chrom AND gs < epos AND pos < ge WHERE qualifies),
gk AS (SELECT gene_id, sample, read_id, count(DISTINCT p5) AS k, min(p5) AS site FROM gm GROUP BY 1, 2, 3),
gl AS (SELECT gk.*, 'genome' AS route, CASE WHEN present AND genome = 'unique' THEN 'shared_unique' WHEN present THEN 'shared_multi' WHEN genome = 'unique' THEN 'genome_only' ELSE 'genome_only_multi' END AS layer FROM gk JOIN cells USING (sample, read_id)),
tm AS (SELECT span.gene_id, a.sample, a.read_id, CASE WHEN xe.strand = '-' THEN g_end - 1 - (a.pos + 12 - tx_start) ELSE g_start + a.pos + 12 - tx_start END AS g FROM aln_t a JOIN selected s ON s.transcript_id = a.transcript_id JOIN span ON span.gene_id = s.gene_id LEFT JOIN xe ON xe.transcript_id = a.transcript_id AND tx_start <= a.pos + 12 AND a.pos + 12 < tx_end),
tk AS (SELECT gene_id, sample, read_id, count(DISTINCT g) AS k, min(g) AS site FROM tm GROUP BY 1, 2, 3),
tl AS (SELECT tk.*, 'txome' AS route, CASE WHEN gk.gene_id IS NULL THEN 'txome_only' WHEN genome = 'unique' THEN 'shared_unique' ELSE 'shared_multi' END AS layer FROM tk LEFT JOIN gk ON gk.gene_id = tk.gene_id AND gk.sample = tk.sample AND gk.read_id = tk.read_id LEFT JOIN cells ON cells.sample = tk.sample AND cells.read_id = tk.read_id),
st AS (SELECT * FROM gl UNION ALL SELECT * FROM tl),
xb AS (SELECT DISTINCT gene_id, unnest(range(g_start, g_end)) AS b FROM exons),
cv AS (SELECT st.* FROM st JOIN xb ON xb.gene_id = st.gene_id AND xb.b = st.site WHERE k = 1),
pos AS (SELECT gene_id, sample, route, site, count(*) AS n FROM cv GROUP BY 1, 2, 3, 4),
rn AS (SELECT gene_id, sample, count(*) AS n_runs FROM (SELECT DISTINCT gene_id, sample, route, n, site - row_number() OVER (PARTITION BY gene_id, sample, route, n ORDER BY site) AS isl FROM pos) GROUP BY 1, 2),
ct AS (SELECT gene_id, sample, """ + ", ".join(f"count(*) FILTER (WHERE route = '{r}' AND layer = '{x}') AS {r}_{x}" for r, names in (("genome", locus.GENOME_LAYERS), ("txome", locus.TXOME_LAYERS)) for x in names) + """, count(*) FILTER (WHERE k > 1) AS n_ambiguous, count(*) FILTER (WHERE k = 0) AS n_unresolved FROM st GROUP BY 1, 2),
cs AS (SELECT gene_id, sample, count(*) FILTER (WHERE route = 'genome') AS genome_cov, count(*) FILTER (WHERE route = 'txome') AS txome_cov FROM cv GROUP BY 1, 2)"""
_COUNTS = [*(f"genome_{x}" for x in locus.GENOME_LAYERS), *(f"txome_{x}" for x in locus.TXOME_LAYERS), "n_ambiguous", "n_unresolved"]


def artifacts(spark, d):
    g, t, exons = inputs(spark, d, "aln_g", "aln_t", "exons")
    return locus.counted_artifacts(g, t, exons, genes.selected_transcripts(exons), 12, WIDTH)


@query(
    "locus_artifact",
    cte("aln_g", "aln_t", "exons") + LOCUS_SQL + f""" SELECT gene_id, sample, (SELECT count(*) FROM xb WHERE xb.gene_id = ct.gene_id) AS n_exonic, {", ".join(_COUNTS)}, coalesce(genome_cov, 0) AS genome_cov, coalesce(txome_cov, 0) AS txome_cov, coalesce(n_runs, 0) AS n_runs
FROM ct LEFT JOIN cs USING (gene_id, sample) LEFT JOIN rn USING (gene_id, sample)""",
)
def locus_artifact(spark, d):
    long = lambda e: F.aggregate(e, F.lit(0).cast("long"), lambda a, x: a + x)
    cov = lambda r: long(F.transform(F.filter("layers", lambda x: x["route"] == r), lambda x: x["depth"] * (x["end"] - x["start"]))).alias(f"{r}_cov")
    return artifacts(spark, d).select(
        "gene_id", "sample", long(F.transform("exons", lambda x: x["end"] - x["start"])).alias("n_exonic"), *(F.col(f"counts.{x}").alias(x) for x in _COUNTS), cov("genome"), cov("txome"), F.size("tracks").cast("long").alias("n_runs")
    )


@query("locus_track_check", cte("aln_g", "aln_t", "exons") + LOCUS_SQL + " SELECT count(*) AS n_artifacts, CAST(0 AS BIGINT) AS n_apart FROM ct")
def locus_track_check(spark, d):
    """How many artifacts there are, and where their layers do not sum to their tracks (nowhere)."""
    # read four times over
    found = stored(artifacts(spark, d))
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(found, "n_artifacts").join(F.broadcast(n(locus.track_violations(found), "n_apart")))  # one row each


_LABELS = {s: s.removeprefix("r7_").replace("_", " ") for s in genes.SEGMENTS}


@query(
    "gene_entry",
    cte("aln_g", "aln_t", "exons") + PARTITION_SQL + """, es AS (SELECT sample, gene_id, count(*) AS n_union, """ + ", ".join(f"count(*) FILTER (WHERE segment = '{x}') AS {x}" for x in genes.SEGMENTS) + " FROM seg GROUP BY 1, 2) "
    + " UNION ALL ".join(f"SELECT sample, es.gene_id, selected.transcript_id, n_union, CAST({k} AS INTEGER) AS segment_order, '{s}' AS segment_key, '{_LABELS[s]}' AS segment_label, {s} AS n_reads, round(1e2 * {s} / n_union, 9) AS pct_of_union FROM es JOIN selected USING (gene_id)" for k, s in enumerate(genes.SEGMENTS)),
)
def gene_entry(spark, d):
    """The partition's counts as entries, written to JSON texts, read back by schema and checked, a row a segment."""
    selected = genes.selected_transcripts(view(spark, d, "exons"))
    dump = partition(spark, d).join(selected, "gene_id").select("sample", "gene_id", "transcript_id", "segment", "n")
    texts = partition_record.to_text(partition_record.entries(dump, genes.SEGMENTS, ["sample"]))
    return rounded(partition_record.tidy(partition_record.from_text(texts, genes.SEGMENTS), _LABELS, ["sample"]), "pct_of_union")


# ---- read lengths, assays, panel and totals

@query(
    "selected_offsets",
    cte("aln_t") + """, m AS (SELECT sample, qlen AS read_length, count(*) % 3 <> 0 AS ok, CAST(qlen - 15 AS INTEGER) AS off FROM aln_t GROUP BY 1, 2)
SELECT a.sample, a.qlen, pos + off AS psite, count(*) AS n FROM aln_t a JOIN m ON m.sample = a.sample AND m.read_length = a.qlen WHERE ok GROUP BY 1, 2, 3""",
)
def selected_offsets(spark, d):
    """P-sites by the read lengths and offsets that a QC master selects; a sample without any would stop the query."""
    aln = view(spark, d, "aln_t")
    counted = aln.groupBy("sample", F.col("qlen").alias("read_length")).agg(F.count("*").alias("n"))
    master = counted.select("sample", "read_length", F.when(F.col("n") % 3 != 0, " True").otherwise("0").alias("in_phase1"), (F.col("read_length") - 15).alias("psite_offset"))
    chosen = qc.selected_lengths(master, aln.select("sample"))
    placed = aln.withColumnRenamed("qlen", "read_length").join(F.broadcast(chosen), ["sample", "read_length"])  # a row a library and length
    return placed.groupBy("sample", F.col("read_length").alias("qlen"), (F.col("pos") + F.col("psite_offset")).alias("psite")).agg(F.count("*").alias("n"))


@query(
    "assay_agreement",
    cte("counts_long") + pq.COUNT_SQL + """, ar AS (SELECT sample, route, transcript_id, sum(n) FILTER (WHERE assay = 'ribo') AS g, sum(n) FILTER (WHERE assay = 'rna') AS t FROM cnt GROUP BY 1, 2, 3),
fr AS (SELECT sample, route, assay, sum(n) FILTER (WHERE transcript_id % 4 <> 0) / sum(n) AS f FROM cnt GROUP BY 1, 2, 3 HAVING sum(n) > 0),
o AS """ + pq.corr_sql("ar", "sample, route", "true") + """ SELECT o.sample, o.route, o.n AS n_transcripts, spearman, pearson, round(a.f, 9) AS ribo_cds_frac, round(b.f, 9) AS rna_cds_frac FROM o LEFT JOIN fr a ON a.sample = o.sample AND a.route = o.route AND a.assay = 'ribo' LEFT JOIN fr b ON b.sample = o.sample AND b.route = o.route AND b.assay = 'rna'""",
)
def assay_agreement(spark, d):
    grid = pq.grid_counts(spark, d)
    totals = grid.groupBy("sample", "assay", "route").agg(F.coalesce(F.sum(F.when(F.col("transcript_id") % 4 != 0, F.col("n"))), F.lit(0)).alias("n_assigned"), F.sum("n").alias("n_retained"))
    out = rounded(counts.assay_agreement(grid, totals), "spearman", "pearson", places=6)
    return rounded(out, "ribo_cds_frac", "rna_cds_frac")


@query(
    "panel_table",
    """WITH o AS (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders GROUP BY 1), v AS (SELECT c_nationkey, c_custkey, c_acctbal::DOUBLE AS bal, log10(n) AS lg FROM customer JOIN o USING (c_custkey)), b AS (SELECT min(bal) AS bl, max(bal) AS bh, min(lg) AS ll, max(lg) AS lh FROM v),
s AS (SELECT c_nationkey, c_custkey, bal, 0.6 * CASE WHEN bh > bl THEN (bal - bl) / (bh - bl) ELSE 0 END + 0.4 * CASE WHEN lh > ll THEN (lg - ll) / (lh - ll) ELSE 0 END + c_custkey * 1e-7 AS score FROM v, b),
t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY score DESC, c_custkey) = 1)
SELECT c_custkey, c_nationkey, round(bal, 1) AS bal, round(score, 3) AS score, n_name FROM t JOIN nation ON n_nationkey = c_nationkey WHERE c_nationkey <> 3""",
)
def panel_table(spark, d):
    """One customer a nation by a score without ties, one nation dropped, with the nation's name; repeats and absent names would stop the query."""
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    values = table(spark, d, "customer").join(orders, "c_custkey").select("c_nationkey", "c_custkey", F.col("c_acctbal").cast("double").alias("bal"), F.log10("n").alias("lg"))
    scored = cohort.weighted_score(cohort.scaled_to_range(values, ["bal", "lg"]), {"bal": 0.6, "lg": 0.4}).withColumn("score", F.col("score") + F.col("c_custkey") * 1e-7)
    best = cohort.top_per_group(cohort.without_ties(scored.select("c_nationkey", "c_custkey", "bal", "score")), "c_nationkey", "score", "c_custkey", 1).drop("rank")
    kept = cohort.assemble_panel(best, best.where("c_nationkey = 3"), best.limit(0), "c_nationkey")
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return cohort.panel_table(kept, names, "c_nationkey", ["c_custkey", "n_name"], {"bal": 1, "score": 3}).select("c_custkey", "c_nationkey", "bal", "score", "n_name")


@query(
    "pseudogene_totals",
    cte("exons") + """, ge AS (SELECT DISTINCT gene_id FROM exons WHERE gene_type = 'protein_coding'), n AS (SELECT gene_id + 2 AS gene_id, count(DISTINCT gene_id) AS n FROM exons WHERE contains(gene_type, 'pseudogene') GROUP BY 1), j AS (SELECT coalesce(n, 0) AS n FROM ge LEFT JOIN n USING (gene_id))
SELECT 'processed' AS category, CAST(sum(n) AS BIGINT) AS n_pseudogenes, count(*) FILTER (WHERE n > 0) AS n_genes, 1e2 * count(*) FILTER (WHERE n > 0) / count(*) AS pct_genes FROM j UNION ALL SELECT c, 0, 0, 0e0 FROM (VALUES ('unprocessed'), ('other'), ('unclassified')) v(c)""",
)
def pseudogene_totals(spark, d):
    return annotate.pseudogene_totals(read_queries.pseudogene_parents(spark, d))
