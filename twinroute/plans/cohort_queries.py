"""Queries over headers, starts, matrices, effects, libraries and labels, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinroute.functions import columns as c
from twinroute.operators import alignments, checks, cluster, cohort, concordance, coords, counts, coverage, locus, qc
from twinroute.plans import position_queries as pq
from twinroute.plans.position_queries import COUNT_SQL, ORDER_SQL, POINT_SQL, TX_SQL
from twinroute.plans.read_queries import WIDTH, rounded
from twinroute.plans.views import cte, table, view

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


def transcripts(spark, d):
    return coords.transcript_table(view(spark, d, "exons"))


# ---- references and ids

HEADER = "SELECT concat('T', cast(transcript_id as string), '.', cast(transcript_id % 3 + 1 as string)) AS name, transcript_len + CASE WHEN transcript_id % 17 = 0 THEN 5 ELSE 0 END AS length FROM {tx} UNION ALL SELECT 'T999999.1', 100"
KNOWN = "SELECT concat('T', cast(transcript_id - transcript_id % 40 % 39 as string), '.9') AS transcript_id, transcript_len FROM {tx} WHERE transcript_id % 13 <> 0"


@query(
    "reference_map_violations",
    cte("exons") + TX_SQL + f""", h AS ({HEADER.format(tx="tx")}), k AS ({KNOWN.format(tx="tx")}),
j AS (SELECT name, length, count(transcript_len) AS n, min(transcript_len) AS expected FROM h LEFT JOIN k ON split_part(h.name, '.', 1) = split_part(k.transcript_id, '.', 1) GROUP BY 1, 2),
p AS (SELECT name, length, expected, CASE WHEN n = 0 THEN 'unknown_reference' WHEN n > 1 THEN 'ambiguous_reference' WHEN expected <> length THEN 'length_differs' END AS problem FROM j) SELECT * FROM p WHERE problem IS NOT NULL""",
)
def reference_map_violations(spark, d):
    tx = transcripts(spark, d)
    return checks.reference_map_violations(spark.sql(HEADER, tx=tx), spark.sql(KNOWN, tx=tx))


@query(
    "universe_counts",
    cte("aln_t", "exons") + """, a AS (SELECT DISTINCT transcript_id FROM aln_t), b AS (SELECT DISTINCT transcript_id, gene_id FROM exons), s AS (SELECT gene_id FROM b JOIN a USING (transcript_id) GROUP BY 1 HAVING count(*) > 1),
u AS (SELECT a.transcript_id AS x, b.transcript_id AS y FROM a FULL JOIN (SELECT DISTINCT transcript_id FROM b) b USING (transcript_id))
SELECT count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS n_shared, count(*) FILTER (WHERE y IS NULL) AS n_header_only, count(*) FILTER (WHERE x IS NULL) AS n_annotation_only, (SELECT count(*) FROM s) AS n_genes_with_several FROM u""",
)
def universe_counts(spark, d):
    return checks.universe_counts(view(spark, d, "aln_t"), view(spark, d, "exons"))


@query("base_ids", cte("exons") + TX_SQL + f" SELECT name, split_part(name, '.', 1) AS base FROM ({HEADER.format(tx='tx')})")
def base_ids(spark, d):
    return spark.sql(HEADER, tx=transcripts(spark, d)).select("name", c.base_id(F.col("name")).alias("base"))


@query("length_filter", cte("exons") + TX_SQL + " SELECT transcript_id, coalesce(cds_start, 0) < 30 OR coalesce(cds_end - cds_start, 0) < 150 OR coalesce(transcript_len - cds_end, 0) < 30 AS filtered FROM txc")
def length_filter(spark, d):
    tx = pq.with_cds(transcripts(spark, d))
    return tx.select("transcript_id", c.filtered_by_length(F.col("cds_start"), F.col("cds_end") - F.col("cds_start"), F.col("transcript_len") - F.col("cds_end")).alias("filtered"))


CDS = "g_start % 3 <> 0"


@query(
    "utr_types",
    cte("exons") + f""", k AS (SELECT transcript_id, min(g_start) AS a, max(g_end) AS b FROM exons WHERE {CDS} GROUP BY 1), u AS (SELECT e.*, a, b FROM exons e JOIN k USING (transcript_id) WHERE NOT ({CDS})),
t AS (SELECT transcript_id, g_start, g_end, CASE WHEN g_end <= a THEN CASE WHEN strand = '-' THEN 'three' ELSE 'five' END WHEN g_start >= b THEN CASE WHEN strand = '-' THEN 'five' ELSE 'three' END END AS utr FROM u) SELECT * FROM t WHERE utr IS NOT NULL""",
)
def utr_types(spark, d):
    exons = view(spark, d, "exons")
    extent = exons.where(CDS).groupBy("transcript_id").agg(F.min("g_start").alias("a"), F.max("g_end").alias("b"))
    kind = c.utr_type(F.col("g_start"), F.col("g_end"), F.col("a"), F.col("b"), F.col("strand"))
    return exons.where(f"NOT ({CDS})").join(extent, "transcript_id").select("transcript_id", "g_start", "g_end", kind.alias("utr")).where("utr IS NOT NULL")


SITES_SQL = f""", st AS (SELECT transcript_id, min(chrom) AS chrom, min(strand) AS strand, CASE WHEN min(strand) = '-' THEN max(g_end) - 1 ELSE min(g_start) END AS site FROM exons WHERE {CDS} GROUP BY 1)"""


@query("cds_start_sites", cte("exons") + SITES_SQL + " SELECT * FROM st")
def cds_start_sites(spark, d):
    return coords.cds_start_sites(view(spark, d, "exons").where(CDS))


def five_prime_points(spark, d):
    return alignments.with_five_prime(view(spark, d, "aln_g").where("NOT is_secondary")).select("sample", "read_id", "qlen", "chrom", "strand", "p5")


@query(
    "start_distances",
    cte("aln_g", "exons") + POINT_SQL + SITES_SQL + """, w AS (SELECT sample, read_id, qlen, st.transcript_id, site, CASE WHEN p.strand = '-' THEN site - p5 ELSE p5 - site END AS rel FROM prim p JOIN st ON p.chrom = st.chrom AND p.strand = st.strand)
SELECT sample, read_id, qlen, transcript_id, CAST(rel AS INTEGER) AS rel FROM w WHERE rel >= -50 AND rel < 30 QUALIFY row_number() OVER (PARTITION BY sample, read_id ORDER BY transcript_id, site) = 1""",
)
def start_distances(spark, d):
    return qc.start_distances(five_prime_points(spark, d), cds_start_sites(spark, d), width=WIDTH)


@query("core_lengths", cte("aln_t", "exons") + TX_SQL + ", h AS (SELECT sample, qlen, count(*) AS n_reads FROM aln_t JOIN txc USING (transcript_id) WHERE cds_start + 15 <= pos AND pos < cds_end - 10 GROUP BY 1, 2) SELECT *, 1e2 * n_reads / sum(n_reads) OVER (PARTITION BY sample) AS pct_reads FROM h")
def core_lengths(spark, d):
    return qc.core_lengths(view(spark, d, "aln_t"), pq.with_cds(transcripts(spark, d)))


@query("core_reads", cte("aln_g", "exons") + POINT_SQL + f" SELECT sample, qlen, count(*) AS n FROM prim p WHERE EXISTS (SELECT 1 FROM exons e WHERE {CDS} AND e.chrom = p.chrom AND e.strand = p.strand AND g_start <= p5 AND p5 < g_end) GROUP BY 1, 2")
def core_reads(spark, d):
    return qc.reads_in_cores(five_prime_points(spark, d), view(spark, d, "exons").where(CDS), WIDTH).groupBy("sample", "qlen").agg(F.count("*").alias("n"))


@query(
    "first_codons",
    cte("aln_t") + """, f AS (SELECT sample, qlen, count(*) AS n, count(*) FILTER (WHERE (pos - 18) % 3 = 0) AS a, count(*) FILTER (WHERE (pos - 18) % 3 = 1) AS b, count(*) FILTER (WHERE (pos - 18) % 3 = 2) AS c FROM aln_t WHERE pos >= 18 AND pos < 48 AND qlen BETWEEN 20 AND 45 GROUP BY 1, 2),
r AS (SELECT sample, qlen, n, round_even(1e2 * a / n, 1) AS frame0_pct, round_even(1e2 * b / n, 1) AS frame1_pct, round_even(1e2 * c / n, 1) AS frame2_pct FROM f) SELECT *, frame0_pct >= 50 AS periodic FROM r""",
)
def first_codons(spark, d):
    points = view(spark, d, "aln_t").where(c.in_length_range(F.col("qlen"))).withColumn("rel", F.col("pos") - 18)
    return qc.first_codons(points).select("sample", "qlen", "n", "frame0_pct", "frame1_pct", "frame2_pct", "periodic")


# ---- checks

FLAGS = "SELECT *, CAST(CASE WHEN is_secondary THEN 256 ELSE 0 END + CASE WHEN read_id % 499 = 7 THEN 1 ELSE 0 END AS INT) AS flag, CASE WHEN read_id % 31 <> 5 THEN nh END AS nh2 FROM {aln}"


@query("paired_end", cte("aln_g") + f", f AS ({FLAGS.format(aln='aln_g')}) SELECT sample FROM f GROUP BY 1 HAVING bool_or(flag % 2 = 1)")
def paired_end(spark, d):
    return checks.paired_end(spark.sql(FLAGS, aln=view(spark, d, "aln_g")))


@query("missing_nh", cte("aln_g") + f", f AS ({FLAGS.format(aln='aln_g')}) SELECT sample, count(*) AS n FROM f WHERE NOT is_secondary AND nh2 IS NULL GROUP BY 1")
def missing_nh(spark, d):
    return checks.missing_nh(spark.sql(FLAGS, aln=view(spark, d, "aln_g")).drop("nh").withColumnRenamed("nh2", "nh"))


@query("duplicate_placements", cte("aln_g") + " SELECT sample, read_id, chrom, score, count(*) AS n FROM aln_g GROUP BY 1, 2, 3, 4 HAVING count(*) > 1")
def duplicate_placements(spark, d):
    return checks.duplicate_keys(view(spark, d, "aln_g"), ["sample", "read_id", "chrom", "score"])


@query("column_differences", cte("aln_g", "aln_t") + """, a AS (SELECT sample, qlen, count(*) AS n, min(pos) AS lo FROM aln_g WHERE NOT is_secondary GROUP BY 1, 2), b AS (SELECT sample, qlen, count(*) AS n, min(pos) AS lo FROM aln_t GROUP BY 1, 2), j AS (SELECT a.n AS an, b.n AS bn, a.lo AS al, b.lo AS bl FROM a JOIN b USING (sample, qlen))
SELECT 'n' AS "column", count(*) FILTER (WHERE an IS DISTINCT FROM bn) AS n_differ FROM j UNION ALL SELECT 'lo', count(*) FILTER (WHERE al IS DISTINCT FROM bl) FROM j""")
def column_differences(spark, d):
    of = lambda x: x.groupBy("sample", "qlen").agg(F.count("*").alias("n"), F.min("pos").alias("lo"))
    return checks.column_differences(of(view(spark, d, "aln_g").where("NOT is_secondary")), of(view(spark, d, "aln_t")), ["sample", "qlen"], ["n", "lo"])


@query("unknown_biotypes", cte("exons") + " SELECT gene_type, count(*) AS n FROM exons WHERE gene_type NOT IN ('lncRNA', 'protein_coding') GROUP BY 1")
def unknown_biotypes(spark, d):
    return checks.unknown_values(view(spark, d, "exons"), "gene_type", ["lncRNA", "protein_coding"])


@query("text_flags", "SELECT p_partkey, trim(lower(p_brand)) IN ('true', '1') AS flag, regexp_replace(lower(trim(p_type)), '[ _]+', '_', 'g') AS label FROM part")
def text_flags(spark, d):
    return table(spark, d, "part").select("p_partkey", c.text_bool(F.col("p_brand")).alias("flag"), c.label_key(F.col("p_type")).alias("label"))


@query("number_arrays", "SELECT o_orderkey, CAST(sum(l_quantity) AS DOUBLE) AS total, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def number_arrays(spark, d):
    """Text arrays of numbers are parsed back and summed."""
    texts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.concat(F.lit("["), F.concat_ws(",", F.collect_list(F.col("l_quantity").cast("string"))), F.lit("]")).alias("x"))
    values = c.number_array(F.col("x"))
    known = texts.join(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", "left_semi")
    return known.select("o_orderkey", F.aggregate(values, F.lit(0.0), lambda a, v: a + v).alias("total"), F.size(values).cast("long").alias("n"))


# ---- matrices and effects


@query("matrix_samples", cte("counts_long") + " SELECT sample, count(DISTINCT assay || route) AS n_matrices, count(DISTINCT assay || route) = 4 AS shared FROM counts_long WHERE NOT (sample = 's3' AND assay = 'rna') GROUP BY 1")
def matrix_samples(spark, d):
    return counts.shared_samples(view(spark, d, "counts_long").where("NOT (sample = 's3' AND assay = 'rna')"))


@query("matrix_index_violations", cte("counts_long") + " SELECT transcript_id, count(DISTINCT assay || route) AS n_matrices FROM counts_long WHERE NOT (transcript_id % 9 = 0 AND route = 'txome') GROUP BY 1 HAVING count(DISTINCT assay || route) < 4")
def matrix_index_violations(spark, d):
    return counts.index_violations(view(spark, d, "counts_long").where("NOT (transcript_id % 9 = 0 AND route = 'txome')"))


ADJUSTED_SQL = """, rk AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS k, count(*) OVER () AS m FROM tt WHERE p IS NOT NULL), adj AS (SELECT transcript_id, least(1.0, min(p * m / k) OVER (ORDER BY p DESC)) AS padj FROM rk)"""


@query("highlights", cte("counts_long") + COUNT_SQL + ADJUSTED_SQL + " SELECT tt.transcript_id, coalesce(padj < 0.6 AND abs(mean) > 0.1, false) AS highlight FROM tt LEFT JOIN adj USING (transcript_id)")
def highlights(spark, d):
    return cohort.highlights(counts.bh_adjusted(pq.tests(spark, d)), 0.6, 0.1).select("transcript_id", "highlight")


@query("effect_ranks", cte("counts_long") + COUNT_SQL + " SELECT transcript_id, row_number() OVER (ORDER BY round(mean, 9), transcript_id) AS rank, round(mean, 9) + 0e0 AS mean FROM tt")
def effect_ranks(spark, d):
    found = cohort.ranked_band(pq.tests(spark, d).withColumn("mean", F.round("mean", 9)))
    return rounded(found.select("transcript_id", F.col("rank").cast("long").alias("rank"), "mean"), "mean")


@query(
    "role_extremes",
    cte("counts_long") + COUNT_SQL + """, v AS (SELECT transcript_id, CASE WHEN transcript_id % 5 = 0 THEN 'housekeeping' WHEN transcript_id % 5 = 1 THEN 'up' ELSE 'down' END AS role, round(mean, 9) AS mean FROM tt),
r AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY abs(mean) DESC, transcript_id) AS place FROM v WHERE mean IS NOT NULL) SELECT role, transcript_id, round(mean, 7) + 0e0 AS mean, place FROM r WHERE place <= CASE WHEN role = 'housekeeping' THEN 5 ELSE 1 END""",
)
def role_extremes(spark, d):
    role = F.when(F.col("transcript_id") % 5 == 0, "housekeeping").when(F.col("transcript_id") % 5 == 1, "up").otherwise("down")
    values = pq.tests(spark, d).select("transcript_id", role.alias("role"), F.round("mean", 9).alias("mean"))
    return rounded(cohort.role_extremes(values, "role", "mean", "transcript_id", "housekeeping").withColumn("place", F.col("place").cast("long")), "mean", places=7)


@query(
    "library_order",
    cte("aln_g", "aln_t") + """, g AS (SELECT sample, count(*) AS n_g FROM aln_g WHERE NOT is_secondary GROUP BY 1), t AS (SELECT sample, count(*) AS n_t FROM aln_t GROUP BY 1)
SELECT sample, n_g - n_t AS difference, row_number() OVER (ORDER BY n_g - n_t, sample) AS place FROM g JOIN t USING (sample)""",
)
def library_order(spark, d):
    of = lambda x, n: x.groupBy("sample").agg(F.count("*").alias(n))
    pairs = of(view(spark, d, "aln_g").where("NOT is_secondary"), "n_g").join(of(view(spark, d, "aln_t"), "n_t"), "sample")
    return cohort.library_order(pairs, "n_t", "n_g").withColumn("place", F.col("place").cast("long"))


@query("concordance_medians", "WITH q AS (" + pq.ORACLES["transcript_concordance"] + "), m AS (SELECT sample, count(spearman) AS n, quantile_cont(spearman, 0.5) AS median FROM q GROUP BY 1) SELECT sample, n, round(median, 5) + 0e0 AS median FROM m")
def concordance_medians(spark, d):
    return rounded(concordance.distribution(pq.transcript_concordance(spark, d)).select("sample", "n", "median"), "median", places=5)


@query(
    "panel_pool",
    cte("aln_t") + """, v AS (SELECT transcript_id, count(*)::DOUBLE AS depth, max(qlen) AS run FROM aln_t GROUP BY 1), p AS (SELECT *, log10(depth) AS log_depth FROM v WHERE depth >= 2 AND run >= 25),
b AS (SELECT min(log_depth) AS a, max(log_depth) AS z, min(run) AS c, max(run) AS e FROM p) SELECT transcript_id, round(0.7 * CASE WHEN z > a THEN (log_depth - a) / (z - a) ELSE 0.0 END + 0.3 * CASE WHEN e > c THEN (run - c)::DOUBLE / (e - c) ELSE 0.0 END, 7) + 0e0 AS score FROM p, b""",
)
def panel_pool(spark, d):
    values = view(spark, d, "aln_t").groupBy("transcript_id").agg(F.count("*").cast("double").alias("depth"), F.max("qlen").alias("run"))
    scored = cohort.weighted_score(cohort.scaled_to_range(cohort.pool(values, 2, 25), ["log_depth", "run"]), {"log_depth": 0.7, "run": 0.3})
    return rounded(scored.select("transcript_id", "score"), "score", places=7)


@query("panel_assembly", cte("exons") + TX_SQL + ", b AS (SELECT transcript_id, gene_id, transcript_len FROM tx) SELECT * FROM b WHERE transcript_id % 10 <> 3 UNION ALL SELECT -transcript_id - 1, gene_id, transcript_len FROM b WHERE transcript_id % 50 = 3")
def panel_assembly(spark, d):
    base = transcripts(spark, d).select("transcript_id", "gene_id", "transcript_len")
    added = base.where("transcript_id % 50 = 3").withColumn("transcript_id", -F.col("transcript_id") - 1)
    return cohort.assemble_panel(base, base.where("transcript_id % 10 = 3"), added, "transcript_id")


# ---- clusters

SHARES_SQL = ", s AS (SELECT transcript_id, count(*) AS n, count(*) FILTER (WHERE qlen < 27) AS a, count(*) FILTER (WHERE qlen >= 27 AND qlen < 34) AS b, count(*) FILTER (WHERE qlen >= 34) AS c FROM aln_t GROUP BY 1), l AS (SELECT *, CASE WHEN a >= b AND a >= c THEN 1 WHEN b >= c THEN 2 ELSE 3 END AS cluster FROM s)"


def labelled(spark, d):
    """Transcripts by the length class that most of their reads have."""
    reads = view(spark, d, "aln_t").groupBy("transcript_id").agg(F.count("*").alias("n"), F.count_if(F.col("qlen") < 27).alias("a"), F.count_if((F.col("qlen") >= 27) & (F.col("qlen") < 34)).alias("b"), F.count_if(F.col("qlen") >= 34).alias("c"))
    kind = F.when((F.col("a") >= F.col("b")) & (F.col("a") >= F.col("c")), 1).when(F.col("b") >= F.col("c"), 2).otherwise(3)
    shares = cluster.composition(reads, ["a", "b", "c"], "n", "transcript_id")
    return shares.join(reads.select("transcript_id", "n", kind.alias("cluster")), "transcript_id")


@query(
    "cluster_centroids",
    cte("aln_t") + SHARES_SQL + """, m AS (SELECT cluster, count(*) AS n_genes, avg(a / n) * 100 AS pa, avg(b / n) * 100 AS pb, avg(c / n) * 100 AS pc FROM (SELECT cluster, n, a::DOUBLE AS a, b::DOUBLE AS b, c::DOUBLE AS c FROM l) GROUP BY 1)
SELECT cluster, n_genes, round(pa, 7) AS pct_a, round(pb, 7) AS pct_b, round(pc, 7) AS pct_c, CASE WHEN pc >= pb AND pc >= pa THEN 'c' WHEN pb >= pa THEN 'b' ELSE 'a' END AS dominant FROM m""",
)
def cluster_centroids(spark, d):
    return rounded(cluster.centroids(labelled(spark, d), ["a", "b", "c"]), "pct_a", "pct_b", "pct_c", places=7)


@query("cluster_summary", cte("aln_t") + SHARES_SQL + " SELECT cluster, count(*) AS n, round(avg((transcript_id % 4 = 0)::INT), 9) AS share, " + ", ".join(f"round(quantile_cont(a::DOUBLE / n, {p / 100}), 9) AS p{p:02d}" for p in (5, 25, 50, 75, 95)) + " FROM l GROUP BY 1")
def cluster_summary(spark, d):
    table_ = labelled(spark, d).withColumn("has", F.col("transcript_id") % 4 == 0)
    return rounded(cohort.cluster_summary(table_, "has", "f_a"), "share", "p05", "p25", "p50", "p75", "p95")


@query("same_partition", cte("aln_t") + SHARES_SQL + ", p AS (SELECT DISTINCT cluster AS x, (cluster + 1) % 3 AS y FROM l) SELECT count(*) = count(DISTINCT x) AND count(*) = count(DISTINCT y) AS same FROM p")
def same_partition(spark, d):
    found = labelled(spark, d)
    return cluster.same_partition(found, found.withColumn("cluster", (F.col("cluster") + 1) % 3), "transcript_id")


@query("label_violations", cte("aln_t") + SHARES_SQL + """, b AS (SELECT transcript_id, CASE WHEN n % 7 = 0 THEN 9 ELSE cluster END AS cluster FROM l WHERE transcript_id % 11 <> 0)
SELECT coalesce(l.transcript_id, b.transcript_id) AS transcript_id, CASE WHEN b.transcript_id IS NULL THEN 'only_left' ELSE 'differs' END AS status, CASE WHEN b.transcript_id IS NULL THEN '' ELSE 'cluster' END AS columns FROM l LEFT JOIN b USING (transcript_id) WHERE l.cluster IS DISTINCT FROM b.cluster""")
def label_violations(spark, d):
    found = labelled(spark, d)
    other = found.where("transcript_id % 11 <> 0").withColumn("cluster", F.when(F.col("n") % 7 == 0, 9).otherwise(F.col("cluster")))
    return checks.label_violations(found, other, "transcript_id")


# ---- loci and reads

@query(
    "isoform_support",
    cte("aln_g", "exons") + """, own AS (SELECT DISTINCT chrom, unnest(range(g_start, g_end)) AS p FROM exons WHERE transcript_id = 4), o AS (SELECT transcript_id, chrom, g_start, g_end FROM exons WHERE gene_id = 2 AND transcript_id <> 4),
b AS (SELECT DISTINCT o.transcript_id, o.chrom, x.p FROM o, LATERAL (SELECT unnest(range(o.g_start, o.g_end)) AS p) x WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.chrom = o.chrom AND own.p = x.p)),
h AS (SELECT b.transcript_id, count(DISTINCT (a.sample, a.read_id)) AS n_reads FROM aln_g a JOIN b ON a.chrom = b.chrom AND a.pos <= b.p AND b.p < a.epos WHERE NOT is_secondary GROUP BY 1)
SELECT transcript_id, count(*) AS n_exons, coalesce(any_value(n_reads), 0) AS n_reads FROM o LEFT JOIN h USING (transcript_id) GROUP BY 1 ORDER BY n_reads DESC, n_exons DESC, transcript_id LIMIT 5""",
)
def isoform_support(spark, d):
    gene = view(spark, d, "exons").where("gene_id = 2")
    return locus.alternative_isoform(view(spark, d, "aln_g").where("NOT is_secondary"), gene, 4).limit(5)


@query(
    "projected_reads",
    cte("aln_t", "exons") + ORDER_SQL + """, p AS (SELECT sample, read_id, transcript_id, pos + 12 AS tpos FROM aln_t)
SELECT p.*, CASE WHEN strand = '-' THEN g_end - 1 - (tpos - tx_start) ELSE g_start + tpos - tx_start END AS gpos FROM p LEFT JOIN xe ON p.transcript_id = xe.transcript_id AND tx_start <= tpos AND tpos < tx_end""",
)
def projected_reads(spark, d):
    reads = view(spark, d, "aln_t").select("sample", "read_id", "transcript_id", (F.col("pos") + 12).alias("tpos"))
    return locus.transcript_to_genome(reads, view(spark, d, "exons")).select("sample", "read_id", "transcript_id", "tpos", "gpos")


@query(
    "read_state",
    cte("aln_g") + """, p AS (SELECT sample, read_id, min((chrom, pos, epos, strand, score)) FILTER (WHERE NOT is_secondary) AS x, max(nh) FILTER (WHERE NOT is_secondary) AS nh, count(*) AS n_placements FROM aln_g GROUP BY 1, 2)
SELECT sample, read_id, nh, n_placements, struct_extract(x, 1) AS chrom, struct_extract(x, 2) AS pos, struct_extract(x, 4) AS strand FROM p""",
)
def read_state(spark, d):
    found = alignments.read_state(view(spark, d, "aln_g"))
    return found.select("sample", "read_id", "nh", F.size("placements").cast("long").alias("n_placements"), "primary.chrom", "primary.pos", "primary.strand")


@query(
    "transcript_tracks",
    cte("aln_t", "exons") + TX_SQL + """, k AS (SELECT transcript_id, cds_start + 15 AS a, cds_end - 15 AS b FROM txc WHERE cds_start IS NOT NULL AND cds_end - cds_start > 30 AND transcript_id < 40),
g AS (SELECT transcript_id, p, x.sample FROM (SELECT transcript_id, unnest(range(a, b)) AS p FROM k), (SELECT DISTINCT sample FROM aln_t) x)
SELECT g.sample, g.transcript_id, CAST(g.p AS BIGINT) AS pos, count(t.read_id) AS n FROM g LEFT JOIN aln_t t ON t.sample = g.sample AND t.transcript_id = g.transcript_id AND t.pos + 12 = g.p GROUP BY 1, 2, 3""",
)
def transcript_tracks(spark, d):
    reads = view(spark, d, "aln_t")
    chosen = pq.with_cds(transcripts(spark, d)).where("transcript_id < 40")
    points = coverage.point_coverage(reads.withColumn("psite", F.col("pos") + 12), ["sample", "transcript_id"], "psite")
    return locus.dense_track(points, chosen, reads.select("sample").distinct(), trim=15)
