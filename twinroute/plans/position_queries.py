"""Queries over positions, counts, tests and cohorts, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from twinroute.functions import columns as c
from twinroute.operators import alignments, annotate, cluster, cohort, concordance, coords, counts, coverage, genes, intervals, locus
from twinroute.plans.read_queries import SELECTED_SQL, WIDTH, gene_counts5, inputs, rounded
from twinroute.plans.views import cte, stored, table, view

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


ORDER_SQL = """,
xo AS (SELECT *, CAST(row_number() OVER w - 1 AS INTEGER) AS exon_index, CAST(coalesce(sum(g_end - g_start) OVER (PARTITION BY transcript_id ORDER BY CASE WHEN strand = '-' THEN -g_end ELSE g_start END, g_start, g_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS tx_start
  FROM exons WINDOW w AS (PARTITION BY transcript_id ORDER BY CASE WHEN strand = '-' THEN -g_end ELSE g_start END, g_start, g_end)),
xe AS (SELECT *, tx_start + g_end - g_start AS tx_end FROM xo)"""
TX_SQL = ORDER_SQL + """,
tx AS (SELECT transcript_id, min(gene_id) AS gene_id, min(chrom) AS chrom, min(strand) AS strand, CAST(sum(g_end - g_start) AS BIGINT) AS transcript_len, count(*) AS n_exons FROM exons GROUP BY 1),
txc AS (SELECT *, CASE WHEN transcript_len > 90 THEN 40 END AS cds_start, CASE WHEN transcript_len > 90 THEN transcript_len - 20 END AS cds_end, transcript_id % 2 = 0 AS has_stop FROM tx)"""
POINT_SQL = """,
prim AS (SELECT *, CASE WHEN strand = '-' THEN epos - 1 ELSE pos END AS p5 FROM aln_g WHERE NOT is_secondary),
ph AS (SELECT sample, read_id, p5, e.* FROM prim p JOIN exons e ON p.chrom = e.chrom AND p.strand = e.strand AND g_start <= p5 AND p5 < g_end),
fh AS (SELECT * FROM ph QUALIFY row_number() OVER (PARTITION BY sample, read_id ORDER BY transcript_id, g_start) = 1),
ov AS (SELECT sample, read_id, transcript_id, CAST(sum(least(epos, g_end) - greatest(pos, g_start)) AS BIGINT) AS n_overlap FROM prim p JOIN exons e ON p.chrom = e.chrom AND p.strand = e.strand AND g_start < epos AND pos < g_end GROUP BY 1, 2, 3)"""


def with_cds(transcripts):
    coding = F.col("transcript_len") > 90
    return transcripts.withColumn("cds_start", F.when(coding, F.lit(40))).withColumn("cds_end", F.when(coding, F.col("transcript_len") - 20)).withColumn("has_stop", F.col("transcript_id") % 2 == 0)


@query(
    "genomic_frames",
    cte("aln_g", "exons") + ORDER_SQL + POINT_SQL + """, w AS (SELECT fh.sample, tx_start, CASE WHEN fh.strand = '-' THEN fh.g_end - 1 - p5 ELSE p5 - fh.g_start END AS k FROM fh JOIN xe ON xe.transcript_id = fh.transcript_id AND xe.g_start = fh.g_start)
SELECT sample, CAST((tx_start + k) % 3 AS INTEGER) AS frame, count(*) AS n FROM w GROUP BY 1, 2""",
)
def genomic_frames(spark, d):
    """Reading frames of first hits from the exon's own phase: the same as along the spliced transcript."""
    phased = coords.exon_order(view(spark, d, "exons")).select("transcript_id", "g_start", F.pmod(-F.col("tx_start"), F.lit(3)).alias("phase"))
    placed = first_hits(spark, d).join(phased, ["transcript_id", "g_start"])
    frame = c.genomic_frame(F.col("p5"), F.col("g_start"), F.col("g_end"), F.col("phase"), F.col("strand"))
    return placed.groupBy("sample", frame.alias("frame")).agg(F.count("*").alias("n"))


@query("exon_cumulative", cte("exons") + ORDER_SQL + " SELECT transcript_id, exon_index, chrom, strand, g_start, g_end, tx_start, tx_end FROM xe")
def exon_cumulative(spark, d):
    return coords.exon_order(view(spark, d, "exons")).select("transcript_id", "exon_index", "chrom", "strand", "g_start", "g_end", "tx_start", "tx_end")


@query("coverage_offset", cte("exons") + TX_SQL + " SELECT *, CAST(coalesce(sum(transcript_len) OVER (ORDER BY transcript_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS coverage_offset FROM tx")
def coverage_offset(spark, d):
    return coords.coverage_offset(coords.transcript_table(view(spark, d, "exons")))


@query(
    "normalized_regions",
    cte("exons") + TX_SQL + """, r AS (SELECT transcript_id, unnest([{'label': 'UTR5', 'a': 0, 'b': cds_start}, {'label': 'CDS', 'a': cds_start, 'b': CASE WHEN has_stop THEN cds_end - 3 ELSE cds_end END}, {'label': 'UTR3', 'a': CASE WHEN has_stop THEN cds_end - 3 ELSE cds_end END, 'b': transcript_len}]) AS p FROM txc WHERE cds_start IS NOT NULL)
SELECT transcript_id, p.label AS label, CAST(p.a AS BIGINT) AS "start", CAST(p.b AS BIGINT) AS "end" FROM r WHERE p.a < p.b""",
)
def normalized_regions(spark, d):
    return coords.normalized_regions(with_cds(coords.transcript_table(view(spark, d, "exons"))))


_BINS = " UNION ALL ".join(
    f"SELECT transcript_id, '{n}' AS label, CAST(greatest(0, least({a}, transcript_len)) AS BIGINT) AS \"start\", CAST(greatest(0, least({b}, transcript_len)) AS BIGINT) AS \"end\" FROM txc WHERE cds_start IS NOT NULL"
    for n, a, b in (("UTR5", "0", "cds_start - 35"), ("UTR5_junction", "cds_start - 35", "cds_start + 10"), ("CDS", "cds_start + 10", "cds_end - 35"), ("UTR3_junction", "cds_end - 35", "cds_end + 10"), ("UTR3", "cds_end + 10", "transcript_len"))
)


@query("junction_bins", cte("exons") + TX_SQL + f', bins AS ({_BINS}) SELECT * FROM bins WHERE "start" < "end"')
def junction_bins(spark, d):
    return coords.junction_bins(with_cds(coords.transcript_table(view(spark, d, "exons"))))


@query(
    "orf_catalog",
    cte("exons") + ORDER_SQL + """, t AS (SELECT transcript_id, max(tx_end) AS cds_len, count(*) AS n FROM xe GROUP BY 1),
nb AS (SELECT x.transcript_id, unnest(range(greatest(0, tx_start - 3), least(cds_len, tx_start + 3))) AS b FROM xe x JOIN t USING (transcript_id) WHERE tx_start > 0), k AS (SELECT transcript_id, count(DISTINCT b) AS n_b FROM nb GROUP BY 1)
SELECT transcript_id, cds_len, cds_len // 3 AS n_codons, cds_len % 3 = 0 AS whole_codons, n AS n_cds_exons, n - 1 AS n_junctions, coalesce(n_b, 0) AS n_junction_bases FROM t LEFT JOIN k USING (transcript_id)""",
)
def orf_catalog(spark, d):
    return coords.orf_catalog(view(spark, d, "exons"))


@query("overlap_pairs", cte("aln_g", "exons") + " SELECT sample, transcript_id, count(*) AS n_pairs, CAST(sum(least(epos, g_end) - greatest(pos, g_start)) AS BIGINT) AS n_bases FROM aln_g a JOIN exons e ON a.chrom = e.chrom AND a.strand = e.strand AND pos < g_end AND g_start < epos GROUP BY 1, 2")
def overlap_pairs(spark, d):
    aln, exons = inputs(spark, d, "aln_g", "exons")
    return coverage.transcript_overlaps(aln, exons)


def points(spark, d):
    aln = alignments.with_five_prime(view(spark, d, "aln_g", by_read=True).where("NOT is_secondary"))
    return aln.select("sample", "read_id", "chrom", "strand", "p5")


def hits(spark, d):
    return coverage.end_hits(points(spark, d), view(spark, d, "exons"), width=WIDTH)


def first_hits(spark, d):
    return coverage.first_hits(points(spark, d), view(spark, d, "exons"), width=WIDTH)


@query("point_first_hit", cte("aln_g", "exons") + POINT_SQL + " SELECT sample, read_id, transcript_id, g_start FROM fh")
def point_first_hit(spark, d):
    return first_hits(spark, d).select("sample", "read_id", "transcript_id", "g_start")


def best_overlaps(spark, d):
    aln = view(spark, d, "aln_g", by_read=True).where("NOT is_secondary").select("sample", "read_id", "chrom", "strand", "pos", "epos")
    return coverage.best_overlap(aln, view(spark, d, "exons"), WIDTH)


@query("max_overlap_assign", cte("aln_g", "exons") + POINT_SQL + " SELECT * FROM ov QUALIFY row_number() OVER (PARTITION BY sample, read_id ORDER BY n_overlap DESC, transcript_id) = 1")
def max_overlap_assign(spark, d):
    return best_overlaps(spark, d).select("sample", "read_id", "transcript_id", "n_overlap")


@query(
    "two_stage_assign",
    cte("aln_g", "exons") + POINT_SQL + """, s1 AS (SELECT sample, read_id, transcript_id, 1 AS stage FROM ph WHERE gene_type = 'protein_coding' QUALIFY row_number() OVER (PARTITION BY sample, read_id ORDER BY transcript_id, g_start) = 1)
SELECT * FROM s1 UNION ALL SELECT sample, read_id, transcript_id, 2 FROM fh WHERE (sample, read_id) NOT IN (SELECT (sample, read_id) FROM s1)""",
)
def two_stage_assign(spark, d):
    exons = view(spark, d, "exons")
    return coverage.two_stage(points(spark, d), exons.where("gene_type = 'protein_coding'"), exons, WIDTH).select("sample", "read_id", "transcript_id", "stage")


@query("cds_counts_unambiguous", cte("aln_g", "exons") + POINT_SQL + " SELECT sample, transcript_id, count(*) AS n FROM (SELECT sample, read_id, min(transcript_id) AS transcript_id FROM ph GROUP BY 1, 2 HAVING count(DISTINCT transcript_id) = 1) GROUP BY 1, 2")
def cds_counts_unambiguous(spark, d):
    return counts.count_features(counts.unambiguous(hits(spark, d)))


@query(
    "count_totals",
    cte("aln_g", "exons") + POINT_SQL + """, k AS (SELECT sample, read_id, count(DISTINCT transcript_id) AS n FROM ph GROUP BY 1, 2), f AS (SELECT sample, count(*) AS a, count(*) FILTER (WHERE n > 1) AS b FROM k GROUP BY 1)
SELECT sample, n_reads, coalesce(a, 0) AS n_assigned, coalesce(b, 0) AS n_ambiguous, coalesce(a - b, 0) AS n_retained FROM (SELECT sample, count(*) AS n_reads FROM prim GROUP BY 1) LEFT JOIN f USING (sample)""",
)
def count_totals(spark, d):
    return counts.count_totals(hits(spark, d), points(spark, d))


@query(
    "assignment_exposure",
    cte("aln_g", "exons") + POINT_SQL + """, p AS (SELECT sample, count(*) AS n_point, count(*) FILTER (WHERE n > 1) AS n_point_ambiguous FROM (SELECT sample, read_id, count(DISTINCT transcript_id) AS n FROM ph GROUP BY 1, 2) GROUP BY 1),
o AS (SELECT sample, count(*) AS n_overlap, count(*) FILTER (WHERE n > 1) AS n_overlap_ambiguous, count(*) FILTER (WHERE k > 1) AS n_overlap_tied FROM (SELECT sample, read_id, count(*) AS n, count(*) FILTER (WHERE n_overlap = top) AS k FROM (SELECT *, max(n_overlap) OVER (PARTITION BY sample, read_id) AS top FROM ov) GROUP BY 1, 2) GROUP BY 1)
SELECT *, 1e2 * n_point_ambiguous / n_point AS pct_point_ambiguous, 1e2 * n_overlap_tied / n_overlap AS pct_overlap_tied FROM p JOIN o USING (sample)""",
)
def assignment_exposure(spark, d):
    return coverage.exposure(hits(spark, d), best_overlaps(spark, d))


def txome_points(spark, d, offset=12, length=120):
    aln = view(spark, d, "aln_t").where("mapq >= 42")
    return aln.withColumn("psite", c.transcript_psite(F.col("pos"), F.lit(offset), F.lit(length)))


@query("point_coverage", cte("aln_t") + " SELECT sample, transcript_id, pos + 12 AS pos, count(*) AS n FROM aln_t WHERE mapq >= 42 AND pos + 12 < 120 GROUP BY 1, 2, 3")
def point_coverage(spark, d):
    return coverage.point_coverage(txome_points(spark, d), ["sample", "transcript_id"], "psite")


@query(
    "depth_segments",
    cte("aln_t") + """, b AS (SELECT sample, transcript_id, unnest(range(pos, least(pos + qlen, 120))) AS p FROM aln_t), k AS (SELECT sample, transcript_id, p, count(*) AS depth FROM b GROUP BY 1, 2, 3),
i AS (SELECT *, p - row_number() OVER (PARTITION BY sample, transcript_id, depth ORDER BY p) AS isl FROM k) SELECT sample, transcript_id, min(p) AS "start", max(p) + 1 AS "end", depth FROM i GROUP BY sample, transcript_id, depth, isl""",
)
def depth_segments(spark, d):
    spans = view(spark, d, "aln_t").select("sample", "transcript_id", F.col("pos").alias("start"), c.clamp(F.col("pos") + F.col("qlen"), F.lit(120)).alias("end"))
    return intervals.depth(spans, ["sample", "transcript_id"], width=32)


# Both routes on one coordinate: the genome route by first hit, the other as reported.
ROUTES_SQL = (
    TX_SQL
    + POINT_SQL
    + """,
gp AS (SELECT fh.sample, fh.transcript_id, xe.tx_start + CASE WHEN fh.strand = '-' THEN fh.g_end - 1 - p5 ELSE p5 - fh.g_start END AS pos, count(*) AS g FROM fh JOIN xe ON xe.transcript_id = fh.transcript_id AND xe.g_start = fh.g_start GROUP BY 1, 2, 3),
tp AS (SELECT a.sample, a.transcript_id, a.pos, count(*) AS t FROM aln_t a JOIN tx ON tx.transcript_id = a.transcript_id WHERE a.pos < transcript_len GROUP BY 1, 2, 3),
pts AS (SELECT coalesce(gp.sample, tp.sample) AS sample, coalesce(gp.transcript_id, tp.transcript_id) AS transcript_id, coalesce(gp.pos, tp.pos) AS pos, coalesce(g, 0) AS g, coalesce(t, 0) AS t FROM gp FULL JOIN tp ON gp.sample = tp.sample AND gp.transcript_id = tp.transcript_id AND gp.pos = tp.pos)"""
)
# The coarse bins of 30 bases give the sparse test data positions that both routes cover.
BINNED_SQL = ROUTES_SQL + """,
bpts AS (SELECT sample, transcript_id, pos // 30 AS pos, CAST(sum(g) AS BIGINT) AS g, CAST(sum(t) AS BIGINT) AS t FROM pts GROUP BY 1, 2, 3),
bzero AS (SELECT s.sample, x.transcript_id, unnest(range(0, (transcript_len + 29) // 30)) AS pos FROM (SELECT DISTINCT sample FROM pts) s, tx x),
ball AS (SELECT z.sample, z.transcript_id, z.pos, coalesce(g, 0) AS g, coalesce(t, 0) AS t FROM bzero z LEFT JOIN bpts b ON b.sample = z.sample AND b.transcript_id = z.transcript_id AND b.pos = z.pos)"""


def corr_sql(source: str, keys: str, where: str) -> str:
    return f"""(SELECT {keys}, count(*) AS n, CASE WHEN count(*) > 2 AND min(g) < max(g) AND min(t) < max(t) THEN round(corr(rg, rt), 6) + 0e0 END AS spearman, CASE WHEN count(*) > 2 AND min(g) < max(g) AND min(t) < max(t) THEN round(corr(log2(g + 1.0), log2(t + 1.0)), 6) + 0e0 END AS pearson FROM
  (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY g) + (count(*) OVER (PARTITION BY {keys}, g) - 1) / 2.0::DOUBLE AS rg, rank() OVER (PARTITION BY {keys} ORDER BY t) + (count(*) OVER (PARTITION BY {keys}, t) - 1) / 2.0::DOUBLE AS rt FROM {source} WHERE {where}) GROUP BY {keys})"""


def route_points(spark, d):
    """(points of both routes, transcript lengths)."""
    aln_t, exons = inputs(spark, d, "aln_t", "exons")
    lengths = coords.transcript_table(exons).select("transcript_id", "transcript_len")
    first = coverage.to_transcript(first_hits(spark, d), exons)
    g = coverage.point_coverage(first, ["sample", "transcript_id"], "tpos")
    t = coverage.point_coverage(aln_t.join(lengths, "transcript_id").where("pos < transcript_len"), ["sample", "transcript_id"], "pos")
    return concordance.paired_points(g, t, ["sample", "transcript_id"]), lengths


def binned(spark, d):
    both, lengths = route_points(spark, d)
    pts = both.groupBy("sample", "transcript_id", F.floor(F.col("pos") / 30).alias("pos")).agg(F.sum("g").alias("g"), F.sum("t").alias("t"))
    return pts, lengths.select("transcript_id", F.ceil(F.col("transcript_len") / 30).alias("n_positions"))


@query(
    "pooled_concordance",
    cte("aln_g", "aln_t", "exons") + BINNED_SQL + f""" SELECT o.sample, o.n_bases_g_only, o.n_bases_t_only, coalesce(i.n, 0) AS n_bases_inter, i.spearman AS spearman_inter, i.pearson AS pearson_inter, u.n AS n_bases_union, u.spearman AS spearman_union, u.pearson AS pearson_union, a.n AS n_bases_all, a.spearman AS spearman_all, a.pearson AS pearson_all
FROM (SELECT sample, count(*) FILTER (WHERE g > 0 AND t = 0) AS n_bases_g_only, count(*) FILTER (WHERE g = 0 AND t > 0) AS n_bases_t_only FROM bpts GROUP BY 1) o LEFT JOIN {corr_sql('ball', 'sample', 'g > 0 AND t > 0')} i USING (sample) LEFT JOIN {corr_sql('ball', 'sample', 'g > 0 OR t > 0')} u USING (sample) LEFT JOIN {corr_sql('ball', 'sample', 'true')} a USING (sample)""",
)
def pooled_concordance(spark, d):
    pts, positions = binned(spark, d)
    found = concordance.pooled(pts, ["sample"], positions.agg(F.sum("n_positions").alias("n_positions")))
    return rounded(found, *(f"{k}_{p}" for k in ("spearman", "pearson") for p in ("inter", "union", "all")), places=6)


@query(
    "transcript_concordance",
    cte("aln_g", "aln_t", "exons") + BINNED_SQL + f", both_tx AS (SELECT sample, transcript_id FROM bpts GROUP BY 1, 2 HAVING sum(g) > 0 AND sum(t) > 0), r AS {corr_sql('ball', 'sample, transcript_id', 'true')} SELECT r.* FROM r JOIN both_tx USING (sample, transcript_id)",
)
def transcript_concordance(spark, d):
    pts, positions = binned(spark, d)
    key = ["sample", "transcript_id"]
    of_key = Window.partitionBy(*key)
    covered = pts.withColumn("_a", F.sum("g").over(of_key)).withColumn("_b", F.sum("t").over(of_key)).where("_a > 0 AND _b > 0")
    hist = concordance.joint_histogram(covered, key)
    return rounded(concordance.correlations(concordance.with_zero_block(hist, key, positions), key), "spearman", "pearson", places=6)


@query(
    "frame_agreement",
    cte("aln_g", "aln_t", "exons") + ROUTES_SQL + """, cod AS (SELECT sample, transcript_id, pos // 3 AS codon, sum(g) AS g, sum(t) AS t, arg_max(pos % 3, (g, -(pos % 3))) AS fg, arg_max(pos % 3, (t, -(pos % 3))) AS ft FROM pts GROUP BY 1, 2, 3)
SELECT sample, count(*) AS n_codons, count(*) FILTER (WHERE fg = ft) AS n_agree, (count(*) FILTER (WHERE fg = ft))::DOUBLE / count(*) AS frame_agree FROM cod WHERE g > 0 AND t > 0 GROUP BY 1""",
)
def frame_agreement(spark, d):
    return concordance.frame_agreement(route_points(spark, d)[0], ["sample"])


@query(
    "coverage_states",
    cte("aln_t") + """, p AS (SELECT sample, transcript_id, count(*) AS n_events, count(*) FILTER (WHERE pos BETWEEN 40 AND 69) AS slice_sum FROM aln_t GROUP BY 1, 2), g AS (SELECT * FROM (SELECT DISTINCT sample FROM aln_t), (SELECT DISTINCT transcript_id FROM aln_t))
SELECT sample, transcript_id, CASE WHEN coalesce(n_events, 0) = 0 THEN 'no_reads' WHEN slice_sum = 0 THEN 'outside_slice' ELSE 'covered' END AS state FROM g LEFT JOIN p USING (sample, transcript_id)""",
)
def coverage_states(spark, d):
    aln = view(spark, d, "aln_t")
    start, end = coords.trimmed(F.lit(30), F.lit(80), 10)
    per = aln.groupBy("sample", "transcript_id").agg(F.count("*").alias("n"), F.count_if((F.col("pos") >= start) & (F.col("pos") < end)).alias("s"))
    grid = counts.zero_filled(per.select("sample", "transcript_id", F.col("n")), aln.select("transcript_id").distinct(), aln.select("sample").distinct())
    return grid.join(per.select("sample", "transcript_id", "s"), ["sample", "transcript_id"], "left").select("sample", "transcript_id", c.coverage_state(F.col("n"), F.col("s")).alias("state"))


# Counts: zero-filled over the grid of features, samples and matrices.
COUNT_SQL = """,
grid AS (SELECT * FROM (SELECT DISTINCT transcript_id FROM counts_long), (SELECT DISTINCT sample FROM counts_long), (VALUES ('ribo', 'genome'), ('ribo', 'txome'), ('rna', 'genome'), ('rna', 'txome')) v(assay, route)),
cnt AS (SELECT grid.*, coalesce(n, 0) AS n FROM grid LEFT JOIN counts_long USING (transcript_id, sample, assay, route)),
gate AS (SELECT transcript_id, count(*) FILTER (WHERE ok) AS n_support FROM (SELECT transcript_id, sample, bool_and(cpm > 4000) AS ok FROM (SELECT *, n * 1e6 / sum(n) OVER (PARTITION BY sample, assay, route) AS cpm FROM cnt) GROUP BY 1, 2) GROUP BY 1),
est AS (SELECT transcript_id FROM cnt GROUP BY 1 HAVING min(n) > 0),
lg AS (SELECT transcript_id, assay, sample, avg(log2(n)) AS l FROM cnt JOIN est USING (transcript_id) GROUP BY 1, 2, 3),
fac AS (SELECT assay, sample, pow(2, quantile_cont(l - ref, 0.5)) AS factor FROM (SELECT *, avg(l) OVER (PARTITION BY transcript_id, assay) AS ref FROM lg) GROUP BY 1, 2),
sc AS (SELECT cnt.*, factor, n / factor AS scaled FROM cnt JOIN fac USING (assay, sample)),
wide AS (SELECT transcript_id, sample, max(scaled) FILTER (WHERE assay = 'ribo' AND route = 'genome') AS bg, max(scaled) FILTER (WHERE assay = 'ribo' AND route = 'txome') AS bt, max(scaled) FILTER (WHERE assay = 'rna' AND route = 'genome') AS ng, max(scaled) FILTER (WHERE assay = 'rna' AND route = 'txome') AS nt FROM sc GROUP BY 1, 2),
dl AS (SELECT transcript_id, sample, CASE WHEN ok THEN log2(nt) - log2(ng) END AS d_rna, CASE WHEN ok THEN log2(bt) - log2(bg) END AS d_ribo, CASE WHEN ok THEN (log2(bt) - log2(bg)) - (log2(nt) - log2(ng)) END AS d_te FROM
  (SELECT transcript_id, sample, CASE WHEN ok THEN bg END AS bg, CASE WHEN ok THEN bt END AS bt, CASE WHEN ok THEN ng END AS ng, CASE WHEN ok THEN nt END AS nt, ok FROM (SELECT *, bg > 0 AND bt > 0 AND ng > 0 AND nt > 0 AS ok FROM wide))),
q AS (SELECT * FROM (VALUES (3, 4.302652729696142), (4, 3.182446305284263), (5, 2.7764451051977987), (6, 2.5705818366147395)) v(n, q)),
s0 AS (SELECT transcript_id, count(d_te) AS n, avg(d_te) AS mean, stddev_samp(d_te) AS sd FROM dl GROUP BY 1 HAVING count(d_te) >= 3),
s1 AS (SELECT s0.*, sd / sqrt(s0.n) AS se, mean - q * (sd / sqrt(s0.n)) AS ci_low, mean + q * (sd / sqrt(s0.n)) AS ci_high, CASE WHEN sd > 0 THEN mean / (sd / sqrt(s0.n)) END AS t FROM s0 JOIN q ON q.n = s0.n),
s2 AS (SELECT *, atan(abs(t) / sqrt(n - 1)) AS th FROM s1),
tt AS (SELECT transcript_id, n, mean, sd, se, ci_low, ci_high, t, CASE n WHEN 3 THEN 1 - sin(th) WHEN 4 THEN 1 - 2 / pi() * (th + sin(th) * cos(th)) WHEN 5 THEN 1 - sin(th) * (1 + cos(th) ** 2 / 2) WHEN 6 THEN 1 - 2 / pi() * (th + sin(th) * (cos(th) + 2.0 / 3 * cos(th) ** 3)) END AS p FROM s2)"""
SAMPLES = [f"s{i}" for i in range(6)]


def grid_counts(spark, d):
    known = view(spark, d, "counts_long")
    cells = known.select("sample").distinct().withColumn("a", F.explode(F.array(F.lit("ribo"), F.lit("rna")))).withColumn("r", F.explode(F.array(F.lit("genome"), F.lit("txome"))))
    return counts.zero_filled(known, known.select("transcript_id").distinct(), cells.select("sample", F.col("a").alias("assay"), F.col("r").alias("route")))


@query("cpm_gate", cte("counts_long") + COUNT_SQL + " SELECT transcript_id, n_support, n_support >= 3 AS kept FROM gate")
def cpm_gate(spark, d):
    return counts.cpm_gate(grid_counts(spark, d), 4000.0, 3)


def factors(spark, d):
    known = grid_counts(spark, d)
    return known, counts.size_factors(known, counts.estimation_rows(known, 4 * len(SAMPLES)))


@query("size_factors", cte("counts_long") + COUNT_SQL + " SELECT assay, sample, round(factor, 9) AS factor FROM fac")
def size_factors(spark, d):
    return rounded(factors(spark, d)[1], "factor")


def scaled(spark, d):
    return counts.scaled(*factors(spark, d))


@query("scaled_counts", cte("counts_long") + COUNT_SQL + " SELECT transcript_id, sample, assay, route, n, round(scaled, 6) AS scaled FROM sc")
def scaled_counts(spark, d):
    return rounded(scaled(spark, d).select("transcript_id", "sample", "assay", "route", "n", "scaled"), "scaled", places=6)


@query("delta_te", cte("counts_long") + COUNT_SQL + " SELECT transcript_id, sample, round(d_rna, 9) + 0e0 AS d_rna, round(d_ribo, 9) + 0e0 AS d_ribo, round(d_te, 9) + 0e0 AS d_te FROM dl")
def delta_te(spark, d):
    return rounded(counts.effects(scaled(spark, d)), "d_rna", "d_ribo", "d_te")


def tests(spark, d):
    return counts.paired_tests(counts.effects(scaled(spark, d)))


@query("te_ttest", cte("counts_long") + COUNT_SQL + " SELECT transcript_id, n, " + ", ".join(f"round({x}, 7) + 0e0 AS {x}" for x in ("mean", "sd", "se", "ci_low", "ci_high", "t", "p")) + " FROM tt")
def te_ttest(spark, d):
    return rounded(tests(spark, d).select("transcript_id", "n", "mean", "sd", "se", "ci_low", "ci_high", "t", "p"), "mean", "sd", "se", "ci_low", "ci_high", "t", "p", places=7)


@query(
    "bh_adjust",
    cte("counts_long") + COUNT_SQL + """, r AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS k, count(*) OVER () AS m FROM tt WHERE p IS NOT NULL)
SELECT tt.transcript_id, round(tt.p, 7) AS p, round(a.padj, 7) AS padj FROM tt LEFT JOIN (SELECT transcript_id, least(1.0, min(p * m / k) OVER (ORDER BY p DESC)) AS padj FROM r) a USING (transcript_id)""",
)
def bh_adjust(spark, d):
    return rounded(counts.bh_adjusted(tests(spark, d)).select("transcript_id", "p", "padj"), "p", "padj", places=7)


@query(
    "route_agreement",
    cte("counts_long") + COUNT_SQL + ", ra AS (SELECT assay, transcript_id, sample, max(n) FILTER (WHERE route = 'genome') AS g, max(n) FILTER (WHERE route = 'txome') AS t FROM cnt GROUP BY 1, 2, 3), o AS " + corr_sql("ra", "assay, sample", "true") + " SELECT * FROM o",
)
def route_agreement(spark, d):
    known = grid_counts(spark, d)
    pair = known.groupBy("assay", "transcript_id", "sample").agg(F.max(F.when(F.col("route") == "genome", F.col("n"))).alias("g"), F.max(F.when(F.col("route") == "txome", F.col("n"))).alias("t"))
    return rounded(concordance.correlations(concordance.joint_histogram(pair, ["assay", "sample"]), ["assay", "sample"]), "spearman", "pearson", places=6)


@query("count_matrix", cte("counts_long") + " SELECT transcript_id, assay, route, " + ", ".join(f"CAST(coalesce(sum(n) FILTER (WHERE sample = '{s}'), 0) AS BIGINT) AS {s}" for s in SAMPLES) + " FROM counts_long GROUP BY 1, 2, 3")
def count_matrix(spark, d):
    return counts.matrix(view(spark, d, "counts_long"), SAMPLES)


@query("top_per_group", "SELECT c_nationkey, c_custkey, c_acctbal, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 3")
def top_per_group(spark, d):
    return cohort.top_per_group(table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), "c_nationkey", "c_acctbal", "c_custkey", 3)


@query(
    "longest_run",
    """WITH o AS (SELECT o_custkey, o_totalprice >= 100000 AS ok, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_totalprice) AS k FROM orders), g AS (SELECT *, k - row_number() OVER (PARTITION BY o_custkey, ok ORDER BY k) AS isl FROM o),
r AS (SELECT o_custkey, ok, count(*) AS n FROM g GROUP BY o_custkey, ok, isl) SELECT o_custkey, CAST(coalesce(max(n) FILTER (WHERE ok), 0) AS INTEGER) AS longest FROM r GROUP BY 1""",
)
def longest_run(spark, d):
    rows = F.sort_array(F.collect_list(F.struct("o_orderkey", "o_totalprice")))
    per = table(spark, d, "orders").groupBy("o_custkey").agg(rows["o_totalprice"].alias("v"))
    return per.select("o_custkey", c.longest_run(F.col("v"), 100000).alias("longest"))


@query(
    "minmax_score",
    """WITH o AS (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders GROUP BY 1), v AS (SELECT c_custkey, c_acctbal::DOUBLE AS bal, ln(1 + coalesce(n, 0)) / ln(10) AS lg FROM customer LEFT JOIN o USING (c_custkey)), b AS (SELECT min(bal) AS bl, max(bal) AS bh, min(lg) AS ll, max(lg) AS lh FROM v)
SELECT c_custkey, round(0.6 * CASE WHEN bh > bl THEN (bal - bl) / (bh - bl) ELSE 0 END + 0.4 * CASE WHEN lh > ll THEN (lg - ll) / (lh - ll) ELSE 0 END, 9) AS score FROM v, b""",
)
def minmax_score(spark, d):
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    values = table(spark, d, "customer").join(orders, "c_custkey", "left").select("c_custkey", F.col("c_acctbal").cast("double").alias("bal"), (F.log(1 + F.coalesce("n", F.lit(0))) / F.log(F.lit(10.0))).alias("lg"))
    return rounded(cohort.weighted_score(cohort.scaled_to_range(values, ["bal", "lg"]), {"bal": 0.6, "lg": 0.4}).select("c_custkey", "score"), "score")


@query("composition_clusters")
def composition_clusters(spark, d):
    parts = [m.removeprefix("n_") for m in genes.METRICS]
    renamed = gene_counts5(spark, d).select("gene_id", "n_union", *(F.col(m).alias(m.removeprefix("n_")) for m in genes.METRICS))
    # fitting reads its points over and over: the partition is worked out once
    labelled = cluster.grouped(stored(cluster.composition(renamed, parts, "n_union", "gene_id")), parts, 4)
    return labelled.select("gene_id", "cluster", *(F.round(f"f_{p}", 9).alias(f"f_{p}") for p in parts))


@query(
    "locus_layers",
    cte("aln_g", "aln_t") + """,
tied AS (SELECT *, max(CASE WHEN NOT is_secondary THEN score END) OVER (PARTITION BY sample, read_id) AS ps FROM aln_g), top AS (SELECT *, CASE WHEN strand = '-' THEN epos - 1 ELSE pos END AS p5 FROM tied WHERE NOT is_secondary OR score = ps),
here AS (SELECT DISTINCT sample, read_id FROM top WHERE chrom = 'chr2' AND pos < 60000 AND epos > 20000), m AS (SELECT top.* FROM top JOIN here USING (sample, read_id) WHERE qlen BETWEEN 25 AND 35),
r AS (SELECT sample, read_id, max(nh) AS nh, count(DISTINCT p5) AS k, min(p5) AS site FROM m GROUP BY 1, 2), t AS (SELECT DISTINCT sample, read_id, true AS there FROM aln_t)
SELECT sample, CASE WHEN nh = 1 AND there THEN 'shared_unique' WHEN there THEN 'shared_multi' WHEN nh = 1 THEN 'genome_only_unique' ELSE 'genome_only_multi' END AS layer, site AS pos, count(*) AS n FROM r LEFT JOIN t USING (sample, read_id) WHERE k = 1 GROUP BY 1, 2, 3""",
)
def locus_layers(spark, d):
    aln, other = inputs(spark, d, "aln_g", "aln_t")
    lengths = aln.select("sample").distinct().withColumn("qlen", F.explode(F.sequence(F.lit(25), F.lit(35))))
    members, _ = locus.locus_reads(alignments.with_five_prime(aln), "chr2", 20000, 60000, lengths)
    sites, _ = locus.placed_once(members, "p5")
    return locus.layer_coverage(sites, locus.read_layers(members, other))


@query(
    "locus_audit",
    cte("aln_g") + """,
tied AS (SELECT *, max(CASE WHEN NOT is_secondary THEN score END) OVER (PARTITION BY sample, read_id) AS ps FROM aln_g), top AS (SELECT * FROM tied WHERE NOT is_secondary OR score = ps),
here AS (SELECT DISTINCT sample, read_id FROM top WHERE chrom = 'chr2' AND pos < 60000 AND epos > 20000), r AS (SELECT sample, read_id, bool_or(qlen BETWEEN 25 AND 35) AS ok, max(nh) AS nh FROM top JOIN here USING (sample, read_id) GROUP BY 1, 2)
SELECT sample, count(*) AS n_locus, count(*) FILTER (WHERE ok) AS n_members, count(*) FILTER (WHERE nh = 1) AS n_unique, count(*) FILTER (WHERE NOT ok) AS n_other_length FROM r GROUP BY 1""",
)
def locus_audit(spark, d):
    aln = view(spark, d, "aln_g")
    lengths = aln.select("sample").distinct().withColumn("qlen", F.explode(F.sequence(F.lit(25), F.lit(35))))
    return locus.locus_reads(aln, "chr2", 20000, 60000, lengths)[1]


@query(
    "coordinate_violations",
    cte("exons") + """, o AS (SELECT *, max(g_end) OVER (PARTITION BY transcript_id ORDER BY g_start, g_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM exons)
SELECT transcript_id, 'overlapping_exons' AS problem FROM o GROUP BY 1 HAVING bool_or(coalesce(before > g_start, false)) UNION ALL SELECT transcript_id, 'several_chromosomes' FROM o GROUP BY 1 HAVING count(DISTINCT chrom) > 1
UNION ALL SELECT transcript_id, 'several_strands' FROM o GROUP BY 1 HAVING count(DISTINCT strand) > 1 UNION ALL SELECT transcript_id, 'empty_exon' FROM o GROUP BY 1 HAVING bool_or(g_end <= g_start)""",
)
def coordinate_violations(spark, d):
    return coords.coordinate_violations(view(spark, d, "exons"))


@query(
    "region_sums",
    cte("aln_t", "exons") + TX_SQL + """, reg AS (SELECT transcript_id, 'UTR5' AS label, 0 AS s, cds_start AS e FROM txc WHERE cds_start IS NOT NULL UNION ALL SELECT transcript_id, 'CDS', cds_start, CASE WHEN has_stop THEN cds_end - 3 ELSE cds_end END FROM txc WHERE cds_start IS NOT NULL
  UNION ALL SELECT transcript_id, 'UTR3', CASE WHEN has_stop THEN cds_end - 3 ELSE cds_end END, transcript_len FROM txc WHERE cds_start IS NOT NULL)
SELECT sample, transcript_id, label, count(*) AS n FROM aln_t JOIN reg USING (transcript_id) WHERE mapq >= 42 AND pos + 12 < 120 AND s <= pos + 12 AND pos + 12 < e GROUP BY 1, 2, 3""",
)
def region_sums(spark, d):
    regions = coords.normalized_regions(with_cds(coords.transcript_table(view(spark, d, "exons"))))
    return coverage.window_sums(point_coverage(spark, d), regions)


@query(
    "largest_overlap_class",
    cte("exons") + """, p AS (SELECT transcript_id * 1000000 + g_start AS id, * FROM exons WHERE gene_type = 'processed_pseudogene'), c AS (SELECT * FROM exons WHERE gene_type <> 'processed_pseudogene'),
o AS (SELECT p.id, c.gene_type AS category, max(least(p.g_end, c.g_end) - greatest(p.g_start, c.g_start)) AS n FROM p JOIN c ON p.chrom = c.chrom AND p.g_start < c.g_end AND c.g_start < p.g_end GROUP BY 1, 2)
SELECT p.id, coalesce((SELECT category FROM o WHERE o.id = p.id ORDER BY n DESC, category LIMIT 1), 'unclassified') AS category FROM p""",
)
def largest_overlap_class(spark, d):
    exons = view(spark, d, "exons")
    ours = F.col("gene_type") == "processed_pseudogene"
    spans = exons.where(ours).select((F.col("transcript_id") * 1000000 + F.col("g_start")).alias("id"), "chrom", F.col("g_start").alias("start"), F.col("g_end").alias("end"))
    classes = exons.where(~ours).select("chrom", F.col("g_start").alias("c_start"), F.col("g_end").alias("c_end"), F.col("gene_type").alias("category"))
    return annotate.largest_overlap(spans, classes, ["chrom"], width=WIDTH).select("id", "category")


@query(
    "omitted_boxes",
    cte("exons") + SELECTED_SQL + """, ex_b AS (SELECT DISTINCT gene_id, unnest(range(g_start, g_end)) AS b FROM exons), se_b AS (SELECT DISTINCT e.gene_id, unnest(range(g_start, g_end)) AS b FROM exons e JOIN selected USING (gene_id, transcript_id)),
f AS (SELECT gene_id, gene_type, 1 - (SELECT count(*) FROM se_b WHERE se_b.gene_id = g.gene_id)::DOUBLE / (SELECT count(*) FROM ex_b WHERE ex_b.gene_id = g.gene_id) AS x FROM (SELECT DISTINCT gene_id, gene_type FROM exons) g)
SELECT gene_type, count(*) AS n, """ + ", ".join(f"round(quantile_cont(x, {p / 100}), 9) AS p{p:02d}" for p in (5, 25, 50, 75, 95)) + " FROM f GROUP BY 1",
)
def omitted_boxes(spark, d):
    exons = view(spark, d, "exons")
    kinds = exons.select("gene_id", "gene_type").distinct()
    found = annotate.omitted_fraction(exons, genes.selected_transcripts(exons)).join(kinds, "gene_id")
    return rounded(cohort.box_stats(found, "omitted_fraction", ["gene_type"]), "p05", "p25", "p50", "p75", "p95")


# bins of 200 a side, a Gaussian of 4 bins cut at 16, one axis after the other, mirrored at the edges
_PASS = """SELECT CASE WHEN m < 200 THEN m ELSE 399 - m END AS {a}, {b}, sum(v * w) AS v FROM (SELECT ((({a} + d) % 400) + 400) % 400 AS m, {b}, v, w FROM {source}, ker) GROUP BY 1, 2"""


@query(
    "effect_density",
    cte("counts_long") + COUNT_SQL + """, ed AS (SELECT transcript_id, sample, d_rna, d_ribo FROM dl WHERE d_te IS NOT NULL), bx AS (SELECT min(d_rna) AS xl, max(d_rna) AS xh, min(d_ribo) AS yl, max(d_ribo) AS yh FROM ed),
eb AS (SELECT ed.*, CASE WHEN xh > xl THEN least(CAST(floor((d_rna - xl) / ((xh - xl) / 200)) AS BIGINT), 199) ELSE 0 END AS ix, CASE WHEN yh > yl THEN least(CAST(floor((d_ribo - yl) / ((yh - yl) / 200)) AS BIGINT), 199) ELSE 0 END AS iy FROM ed, bx),
k0 AS (SELECT d, exp(-0.5 * (d / 4.0) ** 2) AS w FROM range(-16, 17) r(d)), ker AS (SELECT d, w / (SELECT sum(w) FROM k0) AS w FROM k0), g0 AS (SELECT ix, iy, count(*)::DOUBLE AS v FROM eb GROUP BY 1, 2),
g1 AS (""" + _PASS.format(a="ix", b="iy", source="g0") + "), g2 AS (" + _PASS.format(a="iy", b="ix", source="g1") + """)
SELECT transcript_id, sample, round(d_rna, 9) + 0e0 AS d_rna, round(d_ribo, 9) + 0e0 AS d_ribo, round(v, 9) AS density FROM eb JOIN g2 USING (ix, iy)""",
)
def effect_density(spark, d):
    """Local density of transcripts in the plane of both effects."""
    known = counts.effects(scaled(spark, d)).where("d_te IS NOT NULL").select("transcript_id", "sample", "d_rna", "d_ribo")
    return rounded(locus.point_density(known, "d_rna", "d_ribo"), "d_rna", "d_ribo", "density")
