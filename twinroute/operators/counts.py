"""Feature counts, count matrices, shared normalisation, paired effects and tests.

Counts are long: (transcript_id, sample, assay, route, n); wide only at the sink.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinroute.operators.alignments import READ

CELL = ["assay", "route"]


def unambiguous(hits: DataFrame) -> DataFrame:
    """(sample, read_id, transcript_id) of reads that hit one transcript; several exons of one are one hit."""
    one = hits.groupBy(*READ).agg(F.min("transcript_id").alias("transcript_id"), F.max("transcript_id").alias("_last"))
    return one.where(F.col("transcript_id") == F.col("_last")).drop("_last")


def count_features(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("sample", "transcript_id").agg(F.count("*").alias("n"))


def count_totals(hits: DataFrame, total: DataFrame) -> DataFrame:
    """Per sample: reads, assigned, ambiguous, retained."""
    per = hits.groupBy(*READ).agg((F.min("transcript_id") != F.max("transcript_id")).alias("many"))
    found = per.groupBy("sample").agg(F.count("*").alias("n_assigned"), F.count_if("many").alias("n_ambiguous"), F.count_if(~F.col("many")).alias("n_retained"))
    return total.groupBy("sample").agg(F.count("*").alias("n_reads")).join(found, "sample", "left").fillna(0)


def zero_filled(counts: DataFrame, features: DataFrame, cells: DataFrame) -> DataFrame:
    """Counts on the whole grid of features and cells (both small dimensions)."""
    keys = [*features.columns, *cells.columns]
    return features.join(F.broadcast(cells)).join(counts, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long")).select(*keys, "n")


def matrix(counts: DataFrame, samples: list[str]) -> DataFrame:
    """features x samples for every assay and route; missing is 0."""
    return counts.groupBy("transcript_id", *CELL).pivot("sample", samples).agg(F.sum("n")).fillna(0)


def with_cpm(counts: DataFrame) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy("sample", *CELL))
    return counts.withColumn("cpm", F.col("n") * 1e6 / total)


def cpm_gate(counts: DataFrame, least_cpm: float = 1.0, least_samples: int = 12, matrices: int = 4) -> DataFrame:
    """(transcript_id, n_support, kept): samples where the CPM is over the limit in every matrix."""
    per = with_cpm(counts).groupBy("transcript_id", "sample").agg((F.count_if(F.col("cpm") > least_cpm) == matrices).alias("ok"))
    found = per.groupBy("transcript_id").agg(F.count_if("ok").alias("n_support"))
    return found.withColumn("kept", F.col("n_support") >= least_samples)


def estimation_rows(counts: DataFrame, cells: int) -> DataFrame:
    """transcript_id of rows without a zero in any of so many cells."""
    return counts.groupBy("transcript_id").agg(F.min("n").alias("least"), F.count("*").alias("k")).where((F.col("least") > 0) & (F.col("k") == cells)).select("transcript_id")


def size_factors(counts: DataFrame, rows: DataFrame) -> DataFrame:
    """(assay, sample, factor): median of ratios on the geometric mean of both routes, over ``rows``."""
    logs = counts.join(rows, "transcript_id", "left_semi").groupBy("transcript_id", "assay", "sample").agg(F.avg(F.log2(F.col("n").cast("double"))).alias("l"))
    centred = logs.withColumn("d", F.col("l") - F.avg("l").over(Window.partitionBy("transcript_id", "assay")))
    return centred.groupBy("assay", "sample").agg(F.pow(F.lit(2.0), F.percentile("d", 0.5)).alias("factor"))


def scaled(counts: DataFrame, factors: DataFrame) -> DataFrame:
    # one row per assay and sample
    return counts.join(factors, ["assay", "sample"]).withColumn("scaled", F.col("n") / F.col("factor"))


def effects(values: DataFrame) -> DataFrame:
    """(transcript_id, sample, d_rna, d_ribo, d_te): log2 route ratios where all four values are over 0, else null."""
    cell = lambda a, r: F.max(F.when((F.col("assay") == a) & (F.col("route") == r), F.col("scaled")))
    wide = values.groupBy("transcript_id", "sample").agg(cell("ribo", "genome").alias("bg"), cell("ribo", "txome").alias("bt"), cell("rna", "genome").alias("ng"), cell("rna", "txome").alias("nt"))
    usable = (F.col("bg") > 0) & (F.col("bt") > 0) & (F.col("ng") > 0) & (F.col("nt") > 0)
    log = lambda a, b: F.when(usable, F.log2(F.col(a)) - F.log2(F.col(b)))
    out = wide.select("transcript_id", "sample", log("nt", "ng").alias("d_rna"), log("bt", "bg").alias("d_ribo"))
    return out.withColumn("d_te", F.col("d_ribo") - F.col("d_rna"))


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t for whole df >= 1.

    The regularised incomplete beta I_x(df/2, 1/2), x = df / (df + t^2), by its power series, which
    has only positive terms and so keeps small tails exact.
    """
    x = df / (df + t * t)
    a = df / 2.0
    # log B(a, 1/2) by stepping a down to 1/2 or 1
    steps = F.sequence(F.lit(1), F.greatest(F.floor((df - 1) / 2).cast("int"), F.lit(1)))
    base = F.when(F.pmod(df.cast("int"), F.lit(2)) == 0, F.lit(2.0)).otherwise(F.lit(3.141592653589793))
    low = F.when(F.pmod(df.cast("int"), F.lit(2)) == 0, F.lit(1.0)).otherwise(F.lit(0.5))
    beta = F.when(df < 3, base).otherwise(F.aggregate(steps, base, lambda b, k: b * ((low + k - 1) / (low + k - 0.5))))
    # sum of (1/2)_n / n! * x^n * a / (a + n); the ratio tends to x, near 1 the mirrored series is used
    def series(p: Column, q: Column, z: Column) -> Column:
        begin = F.struct(F.lit(1.0).alias("c"), F.lit(1.0).alias("s"))
        step = lambda s, n: F.struct((s["c"] * (n - q) / n * z).alias("c"), (s["s"] + s["c"] * (n - q) / n * z * p / (p + n)).alias("s"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(200)), begin, step, lambda s: s["s"])

    tail = F.pow(x, a) / (a * beta) * series(a, F.lit(0.5), x)
    body = 1.0 - F.sqrt(1.0 - x) / (0.5 * beta) * series(F.lit(0.5), a, 1.0 - x)
    return F.when(x < 0.6, tail).otherwise(body)


# The 0.975 quantile of Student's t for 1 to 30 degrees of freedom.
T_975 = (
    12.706204736432095, 4.302652729696142, 3.182446305284263, 2.7764451051977987, 2.5705818366147395, 2.4469118511449692,
    2.3646242515927844, 2.306004135033371, 2.262157162740992, 2.2281388519649385, 2.200985160082949, 2.1788128296634177,
    2.1603686564610127, 2.1447866879169273, 2.131449545559323, 2.1199052992210112, 2.1098155778331806, 2.10092204024096,
    2.093024054408263, 2.0859634472658364, 2.079613844727662, 2.0738730679040147, 2.0686576104190406, 2.0638985616280205,
    2.059538552753294, 2.055529438642871, 2.0518305164802833, 2.048407141795244, 2.045229642132703, 2.042272456301238,
)


def paired_tests(deltas: DataFrame, column: str = "d_te", least: int = 3) -> DataFrame:
    """Per transcript: n, mean, sd, se, 95 % interval, t and p of the mean against 0; null where the spread is 0."""
    v = F.col(column)
    found = deltas.groupBy("transcript_id").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd")).where(F.col("n") >= least)
    found = found.withColumn("se", F.col("sd") / F.sqrt("n")).withColumn("df", (F.col("n") - 1).cast("double"))
    q = t_quantile_975(F.col("df"))
    found = found.withColumn("ci_low", F.col("mean") - q * F.col("se")).withColumn("ci_high", F.col("mean") + q * F.col("se"))
    found = found.withColumn("t", F.when(F.col("se") > 0, F.col("mean") / F.col("se")))
    return found.withColumn("p", F.when(F.col("t").isNotNull(), t_two_sided(F.col("t"), F.col("df")))).drop("df")


def bh_adjusted(tests: DataFrame, p: str = "p", name: str = "padj") -> DataFrame:
    """Benjamini-Hochberg over the non-null p: min over larger ranks of p m / rank, at most 1.

    One row per transcript, so the ordered window is as small as the annotation.  Equal p get the value of the last of them.
    """
    known = tests.where(F.col(p).isNotNull())
    total = known.agg(F.count("*").alias("_m"))
    ranked = known.groupBy(p).agg(F.count("*").alias("_k"))
    up = Window.orderBy(p).rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.withColumn("_rank", F.sum("_k").over(up)).join(F.broadcast(total)).withColumn("_q", F.col(p) * F.col("_m") / F.col("_rank"))
    down = Window.orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.select(F.col(p).alias("_p"), F.least(F.lit(1.0), F.min("_q").over(down)).alias(name))
    return tests.join(ranked, tests[p] == ranked["_p"], "left").drop("_p")


def shared_samples(counts: DataFrame, matrices: int = 4) -> DataFrame:
    """(sample, n_matrices, shared): in how many of the matrices (assay, route) a sample stands."""
    per = counts.groupBy("sample").agg(F.count_distinct("assay", "route").alias("n_matrices"))
    return per.withColumn("shared", F.col("n_matrices") == matrices)


def index_violations(counts: DataFrame, matrices: int = 4) -> DataFrame:
    """(transcript_id, n_matrices) of features that are not in the index of every matrix."""
    return counts.groupBy("transcript_id").agg(F.count_distinct("assay", "route").alias("n_matrices")).where(F.col("n_matrices") < matrices)


def t_quantile_975(df: Column) -> Column:
    """The 0.975 quantile of Student's t: the table up to 30 degrees of freedom, beyond it the expansion about the normal quantile."""
    z = 1.959963984540054
    terms = ((z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160)
    wide = F.lit(z)
    for power, term in enumerate(terms, 1):
        wide = wide + F.lit(term) / F.pow(df, F.lit(power))
    return F.when(df <= len(T_975), F.get(F.array(*map(F.lit, T_975)), (df - 1).cast("int"))).otherwise(wide)


def assay_agreement(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Per (sample, route): ribo against RNA over all transcripts of the grid, zeros kept, with each assay's share of reads in a CDS.

    counts: the zero-filled grid (transcript_id, sample, assay, route, n), raw: normalising would divide out what is measured.  totals: (sample, assay,
    route, n_assigned, n_retained).  An assay without a read, and a side that does not vary, give null coefficients.
    """
    from twinroute.operators.concordance import correlations, joint_histogram

    key = ["sample", "route"]
    side = lambda a: F.coalesce(F.sum(F.when(F.col("assay") == a, F.col("n"))), F.lit(0))
    pairs = counts.groupBy("transcript_id", *key).agg(side("ribo").alias("g"), side("rna").alias("t"))
    found = correlations(joint_histogram(pairs, key), key)
    share = lambda a: F.max(F.when((F.col("assay") == a) & (F.col("n_retained") > 0), F.col("n_assigned") / F.col("n_retained"))).alias(f"{a}_cds_frac")
    shares = totals.groupBy(*key).agg(share("ribo"), share("rna"))
    return found.join(shares, key, "left").select(*key, F.col("n").alias("n_transcripts"), "spearman", "pearson", "ribo_cds_frac", "rna_cds_frac")
