"""Queries over reads and categories, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinroute.functions import columns as c
from twinroute.operators import alignments, annotate, categories, checks, cohort, genes, intervals, qc
from twinroute.plans.views import cte, view

#: Bin width at the test tables' coordinates.
WIDTH = 256

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def inputs(spark, d, *names):
    return [view(spark, d, n) for n in names]


CELLS_SQL = """,
g AS (SELECT sample, read_id, CASE WHEN min(nh) = 1 THEN 'unique' ELSE 'multi' END AS genome FROM aln_g WHERE NOT is_secondary GROUP BY 1, 2),
t AS (SELECT DISTINCT sample, read_id, true AS there FROM aln_t),
cells AS (SELECT coalesce(g.sample, t.sample) AS sample, coalesce(g.read_id, t.read_id) AS read_id, genome, coalesce(there, false) AS present,
  CASE WHEN genome = 'unique' AND there THEN 'sh_u' WHEN genome = 'multi' AND there THEN 'sh_m' WHEN genome = 'unique' THEN 'go_u' WHEN genome = 'multi' THEN 'go_m' ELSE 'to' END AS cell
  FROM g FULL JOIN t ON g.sample = t.sample AND g.read_id = t.read_id)"""
TIED_SQL = """,
tied AS (SELECT *, max(CASE WHEN NOT is_secondary THEN score END) OVER (PARTITION BY sample, read_id) AS primary_score,
  bool_or(NOT is_secondary) OVER (PARTITION BY sample, read_id) AS has_primary FROM aln_g),
best AS (SELECT *, has_primary AND (NOT is_secondary OR coalesce(score = primary_score, false)) AS qualifies FROM tied)"""
SELECTED_SQL = """,
selected AS (SELECT gene_id, min(transcript_id) AS transcript_id FROM exons GROUP BY 1)"""
TAXONOMY_SQL = (
    CELLS_SQL
    + """,
tax AS (SELECT sample, count(*) AS n_universe, """
    + ", ".join(f"count(*) FILTER (WHERE cell = '{x}') AS n_{x}" for x in categories.CELLS)
    + """, count(*) FILTER (WHERE genome = 'unique') AS n_genome_unique, count(*) FILTER (WHERE genome = 'multi') AS n_genome_multi, count(*) FILTER (WHERE genome IS NULL) AS n_genome_absent,
  count(*) FILTER (WHERE present) AS n_txome_present, count(*) FILTER (WHERE NOT present) AS n_txome_absent FROM cells GROUP BY 1),
taxonomy AS (SELECT *, """
    + ", ".join(f"1e2 * n_{x} / n_universe AS pct_{x}" for x in categories.CELLS)
    + " FROM tax)"
)


@query("read_taxonomy", cte("aln_g", "aln_t") + TAXONOMY_SQL + " SELECT * FROM taxonomy")
def read_taxonomy(spark, d):
    return categories.taxonomy(*inputs(spark, d, "aln_g", "aln_t"))


@query("cohort_quartiles", cte("aln_g", "aln_t") + TAXONOMY_SQL + " SELECT count(*) AS n, round(quantile_cont(pct_sh_m, 0.25), 9) AS q1, round(quantile_cont(pct_sh_m, 0.5), 9) AS median, round(quantile_cont(pct_sh_m, 0.75), 9) AS q3 FROM taxonomy")
def cohort_quartiles(spark, d):
    return rounded(cohort.quartiles(read_taxonomy(spark, d), "pct_sh_m"), "q1", "median", "q3")


def rounded(df, *names, places=9):
    """Rounded for comparison; adding 0 turns -0.0 into 0.0."""
    return df.select(*((F.round(x, places) + F.lit(0.0)).alias(x) if x in names else F.col(x) for x in df.columns))


@query("tied_best_placements", cte("aln_g") + TIED_SQL + " SELECT sample, read_id, chrom, pos, strand, score, is_secondary, primary_score, qualifies FROM best")
def tied_best_placements(spark, d):
    return alignments.tied_best(view(spark, d, "aln_g")).select("sample", "read_id", "chrom", "pos", "strand", "score", "is_secondary", "primary_score", "qualifies")


@query(
    "placement_audit",
    cte("aln_g") + TIED_SQL + """ SELECT sample, count(*) FILTER (WHERE NOT is_secondary) AS n_primary, count(*) FILTER (WHERE is_secondary AND qualifies) AS n_secondary_tied,
  count(*) FILTER (WHERE is_secondary AND has_primary AND score < primary_score) AS n_secondary_lower, count(*) FILTER (WHERE is_secondary AND has_primary AND score > primary_score) AS n_secondary_higher,
  count(*) FILTER (WHERE is_secondary AND has_primary AND (score IS NULL OR primary_score IS NULL)) AS n_missing_score, count(*) FILTER (WHERE is_secondary AND NOT has_primary) AS n_no_primary FROM best GROUP BY 1""",
)
def placement_audit(spark, d):
    return alignments.placement_audit(view(spark, d, "aln_g"))


@query("region_scan", cte("aln_g") + " SELECT sample, read_id, pos, epos, strand, is_secondary FROM aln_g WHERE chrom = 'chr2' AND pos < 40000 AND epos > 20000")
def region_scan(spark, d):
    return alignments.region_scan(view(spark, d, "aln_g"), "chr2", 20000, 40000).select("sample", "read_id", "pos", "epos", "strand", "is_secondary")


@query(
    "psite_positions",
    cte("aln_g") + """ SELECT sample, read_id, strand, CASE WHEN k < cut THEN pos + k ELSE pos + k + gap END AS psite FROM
  (SELECT *, CASE WHEN strand = '-' THEN qlen - 13 ELSE 12 END AS k, CASE WHEN read_id % 3 = 0 THEN qlen - 8 ELSE qlen END AS cut, CASE WHEN read_id % 3 = 0 THEN 50 ELSE 0 END AS gap FROM aln_g WHERE NOT is_secondary)""",
)
def psite_positions(spark, d):
    aln = view(spark, d, "aln_g").where("NOT is_secondary").withColumn("cigar", F.expr("case when read_id % 3 = 0 then concat(qlen - 8, 'M50N8M') else concat(qlen, 'M') end"))
    return aln.select("sample", "read_id", "strand", c.psite(F.col("pos"), F.col("cigar"), F.col("strand"), F.lit(12), F.col("qlen"), "aligned").alias("psite"))


@query("length_histogram", cte("aln_g") + " SELECT sample, qlen, count(*) AS n_reads, 1e2 * count(*) / sum(count(*)) OVER (PARTITION BY sample) AS pct_reads FROM aln_g WHERE NOT is_secondary GROUP BY 1, 2")
def length_histogram(spark, d):
    return qc.length_histogram(view(spark, d, "aln_g").where("NOT is_secondary"))


@query(
    "readlen_window",
    cte("aln_t") + """,
h AS (SELECT s.sample, CAST(l.n AS BIGINT) AS len, count(a.read_id) AS c FROM (SELECT DISTINCT sample FROM aln_t) s, range(21, 41) l(n) LEFT JOIN aln_t a ON a.sample = s.sample AND a.qlen = l.n GROUP BY 1, 2),
tot AS (SELECT sample, CAST(sum(c) AS BIGINT) AS total, arg_max(len, (c, -len)) AS peak, max(c) AS top FROM h GROUP BY 1),
w AS (SELECT sample, peak AS lo, peak AS hi, top AS captured, total FROM tot
  UNION ALL SELECT w.sample, CASE WHEN up THEN lo ELSE lo - 1 END, CASE WHEN up THEN hi + 1 ELSE hi END, captured + CASE WHEN up THEN cu ELSE cl END, total FROM
  (SELECT w.*, u.c AS cu, l.c AS cl, CASE WHEN hi = 40 THEN false WHEN lo = 21 THEN true ELSE u.c >= l.c END AS up FROM w LEFT JOIN h u ON u.sample = w.sample AND u.len = hi + 1 LEFT JOIN h l ON l.sample = w.sample AND l.len = lo - 1
   WHERE captured <= total * 0.85 AND NOT (lo = 21 AND hi = 40)) w)
SELECT sample, CAST(lo AS INTEGER) AS lo, CAST(hi AS INTEGER) AS hi, CAST(captured AS BIGINT) AS captured, total FROM w QUALIFY row_number() OVER (PARTITION BY sample ORDER BY hi - lo DESC) = 1""",
)
def readlen_window(spark, d):
    return qc.length_window(view(spark, d, "aln_t").groupBy("sample", "qlen").agg(F.count("*").alias("n_reads")))


GRID_SQL = """,
grid AS (SELECT k.sample, k.qlen, CAST(r.rel AS INTEGER) AS rel, count(a.read_id) AS n FROM (SELECT DISTINCT sample, qlen FROM aln_t) k, range(-50, 30) r(rel) LEFT JOIN aln_t a ON a.sample = k.sample AND a.qlen = k.qlen AND a.pos - 60 = r.rel GROUP BY 1, 2, 3)"""


def metagene_grid(spark, d):
    return qc.metagene(view(spark, d, "aln_t").withColumn("rel", F.col("pos") - 60))


@query("five_prime_metagene", cte("aln_t") + GRID_SQL + " SELECT * FROM grid")
def five_prime_metagene(spark, d):
    return metagene_grid(spark, d)


@query(
    "psite_offset",
    cte("aln_t") + GRID_SQL + """,
m AS (SELECT sample, qlen, sum(CASE WHEN rel BETWEEN 0 AND 29 AND rel % 3 = 0 THEN n ELSE 0 END) AS m0, sum(CASE WHEN rel BETWEEN 0 AND 29 AND rel % 3 = 1 THEN n ELSE 0 END) AS m1, sum(CASE WHEN rel BETWEEN 0 AND 29 AND rel % 3 = 2 THEN n ELSE 0 END) AS m2,
  arg_max(rel, (n, -rel)) FILTER (WHERE rel < 0) AS peak, max(n) FILTER (WHERE rel < 0) AS top FROM grid GROUP BY 1, 2),
f AS (SELECT *, CASE WHEN m0 + m1 + m2 < 200 OR greatest(m0, m1, m2) / (m0 + m1 + m2) < 0.4 THEN ((peak % 3) + 3) % 3 WHEN m0 >= m1 AND m0 >= m2 THEN 0 WHEN m1 >= m2 THEN 1 ELSE 2 END AS frame FROM m),
th AS (SELECT sample, qlen, frame, top, max(n) FILTER (WHERE rel <= -18) + CAST(trunc((max(n) FILTER (WHERE rel >= -18) - max(n) FILTER (WHERE rel <= -18)) / 6.0) AS INTEGER) AS th
  FROM grid JOIN f USING (sample, qlen) WHERE ((rel % 3) + 3) % 3 = frame GROUP BY 1, 2, 3, 4)
SELECT th.sample, th.qlen, CAST(CASE WHEN top = 0 THEN 12 ELSE coalesce((SELECT -min(rel) FROM grid g WHERE g.sample = th.sample AND g.qlen = th.qlen AND rel > -18 AND rel < -6 AND ((rel % 3) + 3) % 3 = frame AND n > th), 12) END AS INTEGER) AS "offset" FROM th""",
)
def psite_offset(spark, d):
    return qc.psite_offsets(metagene_grid(spark, d))


@query(
    "frame_counts",
    cte("aln_t") + """,
f AS (SELECT sample, qlen, count(*) AS n, count(*) FILTER (WHERE (pos - 18) % 3 = 0) AS n_frame0, count(*) FILTER (WHERE (pos - 18) % 3 = 1) AS n_frame1, count(*) FILTER (WHERE (pos - 18) % 3 = 2) AS n_frame2 FROM aln_t WHERE pos - 18 BETWEEN 0 AND 59 GROUP BY 1, 2)
SELECT *, 1e2 * n_frame0 / n AS pct_frame0, 1e2 * n_frame1 / n AS pct_frame1, 1e2 * n_frame2 / n AS pct_frame2 FROM f""",
)
def frame_counts(spark, d):
    points = view(spark, d, "aln_t").withColumn("rel", F.col("pos") + 12 - 30)
    return qc.frame_counts(qc.assigned_inside(points, "rel", F.lit(60)), "rel")


@query(
    "frame_difference",
    cte("aln_g", "aln_t") + """,
a AS (SELECT sample, qlen, 1e2 * count(*) FILTER (WHERE pos % 3 = 0) / count(*) AS g FROM aln_g WHERE NOT is_secondary GROUP BY 1, 2),
b AS (SELECT sample, qlen, 1e2 * count(*) FILTER (WHERE pos % 3 = 0) / count(*) AS t FROM aln_t GROUP BY 1, 2), x AS (SELECT sample, qlen, t - g AS d FROM a JOIN b USING (sample, qlen))
SELECT round(quantile_cont(d, 0.5), 9) AS median, round(avg(abs(d)), 9) AS mean_abs, round(max(abs(d)), 9) AS max_abs, arg_max(sample, (abs(d), sample, qlen)) AS at_sample, arg_max(qlen, (abs(d), sample, qlen)) AS at_qlen FROM x""",
)
def frame_difference(spark, d):
    g, t = inputs(spark, d, "aln_g", "aln_t")
    return rounded(qc.frame_difference(qc.frame_counts(g.where("NOT is_secondary"), "pos"), qc.frame_counts(t, "pos")), "median", "mean_abs", "max_abs")


@query(
    "selection_pairs",
    cte("aln_g", "aln_t") + """,
a AS (SELECT sample, qlen AS read_length, CAST(qlen - 15 AS DOUBLE) AS g_offset FROM aln_g WHERE NOT is_secondary GROUP BY 1, 2 HAVING count(*) % 3 <> 0),
b AS (SELECT sample, qlen AS read_length, CAST(CASE WHEN count(*) % 5 = 0 THEN 11 ELSE qlen - 15 END AS DOUBLE) AS t_offset FROM aln_t GROUP BY 1, 2, qlen HAVING count(*) % 4 <> 0)
SELECT coalesce(a.sample, b.sample) AS sample, coalesce(a.read_length, b.read_length) AS read_length, g_offset, t_offset,
  CASE WHEN t_offset IS NULL THEN 'genome_only' WHEN g_offset IS NULL THEN 'txome_only' WHEN g_offset = t_offset THEN 'agree' ELSE 'differ' END AS status
FROM a FULL JOIN b ON a.sample = b.sample AND a.read_length = b.read_length""",
)
def selection_pairs(spark, d):
    g, t = inputs(spark, d, "aln_g", "aln_t")
    count = lambda x: x.groupBy("sample", F.col("qlen").alias("read_length")).agg(F.count("*").alias("n"))
    a = count(g.where("NOT is_secondary")).where("n % 3 <> 0").withColumn("psite_offset", (F.col("read_length") - 15).cast("double"))
    b = count(t).where("n % 4 <> 0").withColumn("psite_offset", F.when(F.col("n") % 5 == 0, 11).otherwise(F.col("read_length") - 15).cast("double"))
    return qc.paired_selection(a, b)


PLACE_SQL = """,
bodies AS (SELECT gene_id, chrom, min(g_start) AS b_start, max(g_end) AS b_end FROM exons GROUP BY 1, 2),
placed AS (SELECT *, CASE WHEN strand = '-' THEN epos - 1 ELSE pos END AS p5, row_number() OVER (PARTITION BY sample, read_id ORDER BY is_secondary, chrom, pos, epos, strand, score) AS k FROM best),
ex AS (SELECT sample, read_id, k, arg_min(gene_type, (CASE gene_type WHEN 'protein_coding' THEN 0 WHEN 'lncRNA' THEN 1 ELSE 2 END, gene_type)) AS exon_type FROM placed JOIN exons ON placed.chrom = exons.chrom AND g_start <= p5 AND p5 < g_end GROUP BY 1, 2, 3),
bo AS (SELECT DISTINCT sample, read_id, k, true AS in_body FROM placed JOIN bodies ON placed.chrom = bodies.chrom AND b_start <= p5 AND p5 < b_end),
typed AS (SELECT placed.*, coalesce(exon_type, CASE WHEN in_body THEN 'intronic' ELSE 'intergenic' END) AS biotype FROM placed LEFT JOIN ex USING (sample, read_id, k) LEFT JOIN bo USING (sample, read_id, k))"""


@query("biotype_lookup", cte("aln_g", "exons") + TIED_SQL + PLACE_SQL + " SELECT sample, biotype, is_secondary, count(*) AS n FROM typed GROUP BY 1, 2, 3")
def biotype_lookup(spark, d):
    aln, exons = inputs(spark, d, "aln_g", "exons")
    places = alignments.with_five_prime(aln).groupBy("sample", "is_secondary", "chrom", "p5").agg(F.count("*").alias("n"))
    return categories.locus_biotype(places, exons, width=WIDTH).groupBy("sample", "biotype", "is_secondary").agg(F.sum("n").alias("n"))


_TIE_NAMES = (*categories.TIES, "n_qualifying")


@query(
    "tie_categories",
    cte("aln_g", "aln_t", "exons") + CELLS_SQL + TIED_SQL + PLACE_SQL + """,
fl AS (SELECT sample, read_id, min(biotype) FILTER (WHERE NOT is_secondary) AS p, bool_or(is_secondary AND qualifies AND biotype = 'protein_coding') AS pc, bool_or(is_secondary AND qualifies AND biotype = 'processed_pseudogene') AS pp
  FROM typed JOIN cells USING (sample, read_id) WHERE cell = 'sh_m' GROUP BY 1, 2),
la AS (SELECT sample, CASE WHEN p = 'protein_coding' AND pp THEN 'cross_pc_pp' WHEN p = 'processed_pseudogene' AND pc THEN 'cross_pp_pc' WHEN p = 'protein_coding' AND pc THEN 'same_pc_pc' WHEN p = 'processed_pseudogene' AND pp THEN 'same_pp_pp' END AS label FROM fl),
r AS (SELECT sample, count(*) AS n_reads, """
    + ", ".join(f"count(*) FILTER (WHERE label = '{t}') AS {t}" for t in categories.TIES)
    + ", count(label) AS n_qualifying FROM la GROUP BY 1) SELECT *, "
    + ", ".join(f"1e2 * {t} / n_reads AS pct_{t}" for t in _TIE_NAMES)
    + " FROM r",
)
def tie_categories(spark, d):
    return categories.tie_rows(categories.tie_labels(*inputs(spark, d, "aln_g", "aln_t", "exons"), width=WIDTH))


OMIT_SQL = """,
ex_bases AS (SELECT DISTINCT gene_id, chrom, unnest(range(g_start, g_end)) AS b FROM exons),
sel_bases AS (SELECT DISTINCT e.gene_id, e.chrom, unnest(range(g_start, g_end)) AS b FROM exons e JOIN selected s USING (gene_id, transcript_id)),
om_bases AS (SELECT * FROM ex_bases EXCEPT SELECT * FROM sel_bases),
om AS (SELECT gene_id, chrom, min(b) AS "start", max(b) + 1 AS "end" FROM (SELECT *, b - row_number() OVER (PARTITION BY gene_id, chrom ORDER BY b) AS isl FROM om_bases) GROUP BY gene_id, chrom, isl)"""
REACH_SQL = (
    SELECTED_SQL
    + OMIT_SQL
    + """,
gou AS (SELECT a.* FROM aln_g a JOIN cells USING (sample, read_id) WHERE NOT is_secondary AND cell = 'go_u'),
hit AS (SELECT a.sample, a.read_id, min((CASE WHEN gene_type = 'protein_coding' AND s.transcript_id IS NOT NULL THEN 0 WHEN gene_type = 'protein_coding' THEN 1 WHEN contains(gene_type, 'pseudogene') THEN 2 ELSE 3 END, e.gene_id, s.transcript_id)) AS b
  FROM gou a JOIN exons e ON a.chrom = e.chrom AND e.g_start < a.epos AND a.pos < e.g_end LEFT JOIN selected s ON s.gene_id = e.gene_id GROUP BY 1, 2),
bdy AS (SELECT gene_id, chrom, min(g_start) AS b_start, max(g_end) AS b_end FROM exons GROUP BY 1, 2),
lab AS (SELECT a.sample, a.read_id, b[1] AS rank,
  CASE WHEN b[1] = 0 THEN CASE WHEN EXISTS (SELECT 1 FROM exons x WHERE x.transcript_id = b[3] AND x.chrom = a.chrom AND x.g_start <= a.pos AND a.epos <= x.g_end AND x.strand = a.strand) THEN 'representable_not_present_in_dedup_bam' ELSE 'nonselected_isoform_exon' END
    WHEN b[1] = 1 THEN 'protein_coding_gene_omitted' WHEN b[1] = 2 THEN 'pseudogene' WHEN b[1] = 3 THEN 'non_protein_coding_gene'
    WHEN EXISTS (SELECT 1 FROM bdy WHERE bdy.chrom = a.chrom AND b_start < a.epos AND a.pos < b_end) THEN 'intronic' ELSE 'intergenic' END AS label,
  EXISTS (SELECT 1 FROM om WHERE om.chrom = a.chrom AND om."start" < a.epos AND a.pos < om."end") AS on_omitted
  FROM gou a LEFT JOIN hit h ON h.sample = a.sample AND h.read_id = a.read_id)"""
)


@query(
    "reach_categories",
    cte("aln_g", "aln_t", "exons") + CELLS_SQL + REACH_SQL + """,
u AS (SELECT sample, count(*) AS n_genome_unique, count(*) FILTER (WHERE present) AS n_sh_u, count(*) FILTER (WHERE NOT present) AS n_go_u FROM cells WHERE genome = 'unique' GROUP BY 1),
r AS (SELECT sample, """
    + ", ".join(f"count(*) FILTER (WHERE label = '{x}') AS n_{x}" for x in categories.REACH)
    + """, count(*) FILTER (WHERE on_omitted) AS n_omitted_exon_overlap FROM lab GROUP BY 1),
j AS (SELECT u.*, """
    + ", ".join(f"coalesce(n_{x}, 0) AS n_{x}" for x in (*categories.REACH, "omitted_exon_overlap"))
    + " FROM u LEFT JOIN r USING (sample)) SELECT *, "
    + ", ".join(f"CASE WHEN n_go_u > 0 THEN 1e2 * n_{x} / n_go_u END AS pct_{x}" for x in (*categories.REACH, "omitted_exon_overlap"))
    + " FROM j",
)
def reach_categories(spark, d):
    g, t, exons = inputs(spark, d, "aln_g", "aln_t", "exons")
    return categories.reach_rows(g, t, exons, genes.selected_transcripts(exons), WIDTH)


PARTITION_SQL = (
    CELLS_SQL
    + TIED_SQL
    + PLACE_SQL
    + REACH_SQL
    + """,
span AS (SELECT gene_id, min(chrom) AS chrom, min(g_start) AS gs, max(g_end) AS ge FROM exons GROUP BY 1 HAVING count(DISTINCT chrom) = 1),
gside AS (SELECT DISTINCT span.gene_id, sample, read_id FROM best JOIN span ON best.chrom = span.chrom AND gs < epos AND pos < ge WHERE qualifies),
tside AS (SELECT DISTINCT s.gene_id, a.sample, a.read_id FROM aln_t a JOIN selected s ON s.transcript_id = a.transcript_id JOIN span USING (gene_id)),
sides AS (SELECT coalesce(g2.gene_id, t2.gene_id) AS gene_id, coalesce(g2.sample, t2.sample) AS sample, coalesce(g2.read_id, t2.read_id) AS read_id, g2.gene_id IS NOT NULL AS genome_side, t2.gene_id IS NOT NULL AS txome_side
  FROM gside g2 FULL JOIN tside t2 ON g2.gene_id = t2.gene_id AND g2.sample = t2.sample AND g2.read_id = t2.read_id),
atg AS (SELECT DISTINCT e.gene_id, p.sample, p.read_id, p.k, p.biotype = 'processed_pseudogene' AS pp FROM typed p JOIN exons e ON e.chrom = p.chrom AND e.gene_type = 'protein_coding' AND g_start <= p5 AND p5 < g_end WHERE qualifies),
natg AS (SELECT gene_id, sample, read_id, count(*) AS n_at, count(*) FILTER (WHERE pp) AS n_both FROM atg GROUP BY 1, 2, 3),
npp AS (SELECT sample, read_id, count(*) FILTER (WHERE biotype = 'processed_pseudogene') AS n_pp FROM typed WHERE qualifies GROUP BY 1, 2),
tie AS (SELECT gene_id, sample, read_id FROM natg JOIN npp USING (sample, read_id) WHERE n_at > 0 AND n_pp > 0 AND NOT (n_at = 1 AND n_pp = 1 AND n_both = 1)),
alt AS (SELECT DISTINCT om.gene_id, a.sample, a.read_id FROM gou a JOIN om ON om.chrom = a.chrom AND om."start" < a.epos AND a.pos < om."end"),
cat AS (SELECT s.*, genome, present, CASE WHEN NOT genome_side AND genome IS NULL THEN 'txome_only_genome_absent' WHEN NOT genome_side THEN 'txome_only_genome_elsewhere'
  WHEN genome = 'multi' AND tie.gene_id IS NOT NULL THEN 'genome_multi_top_at_gene_pseudogene_tie' WHEN genome = 'multi' THEN 'genome_multi_top_at_gene_no_pseudogene_tie'
  WHEN present THEN 'genome_unique_txome_present' WHEN alt.gene_id IS NOT NULL THEN 'genome_unique_absent_omitted_exon'
  ELSE CASE label WHEN 'splice_junction_absent' THEN 'genome_unique_absent_splice_junction' WHEN 'representable_not_present_in_dedup_bam' THEN 'genome_unique_absent_representable' WHEN 'pseudogene' THEN 'genome_unique_absent_pseudogene' ELSE 'genome_unique_absent_other' END END AS category
  FROM sides s LEFT JOIN cells USING (sample, read_id) LEFT JOIN tie ON tie.gene_id = s.gene_id AND tie.sample = s.sample AND tie.read_id = s.read_id LEFT JOIN alt ON alt.gene_id = s.gene_id AND alt.sample = s.sample AND alt.read_id = s.read_id LEFT JOIN lab ON lab.sample = s.sample AND lab.read_id = s.read_id),
seg AS (SELECT *, CASE WHEN category = 'genome_unique_txome_present' THEN 'r7_shared_unique' WHEN starts_with(category, 'genome_multi_') AND NOT present THEN 'r7_gonly_multi' WHEN category = 'genome_multi_top_at_gene_pseudogene_tie' THEN 'r7_shared_multi_pp'
  WHEN category = 'genome_multi_top_at_gene_no_pseudogene_tie' THEN 'r7_shared_multi_other' WHEN category = 'genome_unique_absent_omitted_exon' THEN 'r7_gonly_unique_omit' WHEN starts_with(category, 'genome_unique_absent_') THEN 'r7_gonly_unique_other' ELSE 'r7_txonly' END AS segment FROM cat),
segs AS (SELECT gene_id, count(*) AS n_union, """
    + ", ".join(f"count(*) FILTER (WHERE segment = '{x}') AS {x}" for x in genes.SEGMENTS)
    + """ FROM seg GROUP BY 1),
met AS (SELECT gene_id, n_union, """
    + ", ".join(f"{' + '.join(p)} AS {m}" for m, p in genes.METRICS.items())
    + " FROM segs)"
)


def partition(spark, d):
    g, (t, exons) = view(spark, d, "aln_g", by_read=True), inputs(spark, d, "aln_t", "exons")
    return genes.partition_counts(g, t, exons, genes.selected_transcripts(exons), WIDTH)


@query("gene_partition10", cte("aln_g", "aln_t", "exons") + PARTITION_SQL + " SELECT sample, gene_id, count(*) AS n_union, count(*) FILTER (WHERE genome_side) AS n_genome_side, count(*) FILTER (WHERE txome_side) AS n_txome_side, count(*) FILTER (WHERE genome_side AND txome_side) AS n_shared, " + ", ".join(f"count(*) FILTER (WHERE category = '{x}') AS {x}" for x in genes.CATEGORIES) + " FROM seg GROUP BY 1, 2")
def gene_partition10(spark, d):
    return genes.category_table(partition(spark, d))


@query("gene_partition7", cte("aln_g", "aln_t", "exons") + PARTITION_SQL + " SELECT * FROM segs")
def gene_partition7(spark, d):
    return genes.segment_table(partition(spark, d))


@query("gene_counts5", cte("aln_g", "aln_t", "exons") + PARTITION_SQL + " SELECT *, " + ", ".join(f"1e2 * {m} / n_union AS {m.replace('n_', 'pct_', 1)}" for m in genes.METRICS) + ", CASE WHEN n_union >= 100 THEN 'ok' ELSE 'low_depth' END AS status FROM met")
def gene_counts5(spark, d):
    return genes.metric_table(gene_partition7(spark, d))


@query("library_summary", cte("aln_g", "aln_t", "exons") + PARTITION_SQL + " " + " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST(sum({m}) AS BIGINT) AS n, round(avg(({m} = 0)::INT), 9) AS zero_share, round(quantile_cont(1e2 * {m} / n_union, 0.1), 9) AS d1, round(quantile_cont(1e2 * {m} / n_union, 0.9), 9) AS d9 FROM met" for m in genes.METRICS))
def library_summary(spark, d):
    found = genes.library_summary(gene_counts5(spark, d))
    return rounded(found.select("metric", "n", "zero_share", F.get("deciles", F.lit(0)).alias("d1"), F.get("deciles", F.lit(8)).alias("d9")), "zero_share", "d1", "d9")


@query("partition_violations", cte("aln_g", "aln_t", "exons") + PARTITION_SQL + f" SELECT count(*) AS n_genes, count(*) FILTER (WHERE {' + '.join(genes.SEGMENTS)} <> n_union) AS n_violations FROM segs")
def partition_violations(spark, d):
    ok = checks.partition_of(gene_partition7(spark, d), list(genes.SEGMENTS), "n_union")
    return gene_partition7(spark, d).agg(F.count("*").alias("n_genes"), F.count_if(~ok).alias("n_violations"))


@query(
    "table_diff",
    cte("aln_g", "aln_t") + """,
a AS (SELECT sample, qlen, count(*) AS n, min(pos) AS lo FROM aln_g WHERE NOT is_secondary GROUP BY 1, 2), b AS (SELECT sample, qlen, count(*) AS n, min(pos) AS lo FROM aln_t GROUP BY 1, 2)
SELECT coalesce(a.sample, b.sample) AS sample, coalesce(a.qlen, b.qlen) AS qlen, CASE WHEN b.sample IS NULL THEN 'only_left' WHEN a.sample IS NULL THEN 'only_right' ELSE 'differs' END AS status,
  CASE WHEN a.sample IS NULL OR b.sample IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.n <> b.n THEN 'n' END, CASE WHEN a.lo <> b.lo THEN 'lo' END) END AS columns
FROM a FULL JOIN b ON a.sample = b.sample AND a.qlen = b.qlen WHERE a.n IS DISTINCT FROM b.n OR a.lo IS DISTINCT FROM b.lo""",
)
def table_diff(spark, d):
    g, t = inputs(spark, d, "aln_g", "aln_t")
    shape = lambda x: x.groupBy("sample", "qlen").agg(F.count("*").alias("n"), F.min("pos").alias("lo"))
    return checks.table_diff(shape(g.where("NOT is_secondary")), shape(t), ["sample", "qlen"], ["n", "lo"])


@query("five_region_counts", cte("aln_t") + " SELECT sample, CAST(CASE WHEN pos < 15 THEN 0 WHEN pos < 60 THEN 1 WHEN pos < 65 THEN 2 WHEN pos < 110 THEN 3 ELSE 4 END AS INTEGER) AS region, count(*) AS n FROM aln_t GROUP BY 1, 2")
def five_region_counts(spark, d):
    return view(spark, d, "aln_t").groupBy("sample", c.five_regions(F.col("pos"), F.lit(50), F.lit(100)).cast("int").alias("region")).agg(F.count("*").alias("n"))


@query("omitted_fraction", cte("exons") + SELECTED_SQL + OMIT_SQL + """, a AS (SELECT gene_id, chrom, count(*) AS n_exonic FROM ex_bases GROUP BY 1, 2), b AS (SELECT gene_id, chrom, count(*) AS n_omitted FROM om_bases GROUP BY 1, 2)
SELECT a.gene_id, a.chrom, n_exonic, coalesce(n_omitted, 0) AS n_omitted, coalesce(n_omitted, 0)::DOUBLE / n_exonic AS omitted_fraction FROM a LEFT JOIN b USING (gene_id, chrom)""")
def omitted_fraction(spark, d):
    exons = view(spark, d, "exons")
    return annotate.omitted_fraction(exons, genes.selected_transcripts(exons))


@query("interval_subtract", cte("exons") + SELECTED_SQL + OMIT_SQL + " SELECT * FROM om")
def interval_subtract(spark, d):
    exons = view(spark, d, "exons")
    return categories.omitted_exons(exons, genes.selected_transcripts(exons), WIDTH)


@query("interval_merge", cte("exons") + SELECTED_SQL + OMIT_SQL + " SELECT gene_id, chrom, min(b) AS g_start, max(b) + 1 AS g_end FROM (SELECT *, b - row_number() OVER (PARTITION BY gene_id, chrom ORDER BY b) AS isl FROM ex_bases) GROUP BY gene_id, chrom, isl")
def interval_merge(spark, d):
    return intervals.merge(view(spark, d, "exons"), ["gene_id", "chrom"], "g_start", "g_end", WIDTH).select("gene_id", "chrom", "g_start", "g_end")


@query("merged_length", cte("exons") + SELECTED_SQL + OMIT_SQL + " SELECT gene_id, chrom, count(*) AS n_bases FROM ex_bases GROUP BY 1, 2")
def merged_length(spark, d):
    return intervals.merged_length(view(spark, d, "exons"), ["gene_id", "chrom"], "g_start", "g_end", WIDTH)


@query(
    "exon_duplication",
    cte("exons") + """, b AS (SELECT DISTINCT chrom, strand, transcript_id, unnest(range(g_start, g_end)) AS b FROM exons), n AS (SELECT *, count(*) OVER (PARTITION BY chrom, strand, b) AS k FROM b)
SELECT transcript_id, count(*) AS n_exonic, count(*) FILTER (WHERE k > 1) AS n_duplicated, (count(*) FILTER (WHERE k > 1))::DOUBLE / count(*) AS duplicated_fraction FROM n GROUP BY 1""",
)
def exon_duplication(spark, d):
    return annotate.duplication(view(spark, d, "exons"), width=WIDTH)


@query(
    "duplication_partners",
    cte("exons") + """, p AS (SELECT DISTINCT a.transcript_id, b.transcript_id AS partner, a.gene_id = b.gene_id AS same_gene FROM exons a JOIN exons b ON a.chrom = b.chrom AND a.strand = b.strand AND a.g_start < b.g_end AND b.g_start < a.g_end AND a.transcript_id <> b.transcript_id)
SELECT transcript_id, count(*) AS n_partners, string_agg(partner, ';' ORDER BY partner) AS partners, count(*) FILTER (WHERE NOT same_gene) AS n_other_gene FROM p GROUP BY 1""",
)
def duplication_partners(spark, d):
    return annotate.partner_lists(view(spark, d, "exons"), width=WIDTH)


@query(
    "pseudogene_parents",
    cte("exons") + """, ps AS (SELECT DISTINCT gene_id, gene_type FROM exons WHERE contains(gene_type, 'pseudogene')), ge AS (SELECT DISTINCT gene_id FROM exons WHERE gene_type = 'protein_coding'),
n AS (SELECT gene_id + 2 AS gene_id, count(*) AS n FROM ps GROUP BY 1) SELECT ge.gene_id, coalesce(n, 0) AS n_processed, 0::BIGINT AS n_unprocessed, 0::BIGINT AS n_other, 0::BIGINT AS n_unclassified, coalesce(n, 0) > 0 AS has_processed, false AS has_unprocessed, false AS has_other, false AS has_unclassified FROM ge LEFT JOIN n USING (gene_id)""",
)
def pseudogene_parents(spark, d):
    exons = view(spark, d, "exons").select("gene_id", "gene_type").distinct()
    pseudo = exons.where(F.col("gene_type").contains("pseudogene")).withColumn("parent_id", F.col("gene_id") + 2)
    return annotate.pseudogene_counts(pseudo, exons.where("gene_type = 'protein_coding'"))
