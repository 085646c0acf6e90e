"""Agreement of two routes: rank and log correlations over joint histograms, and reading-frame agreement.

A joint histogram (g, t, w) holds how many positions have each pair of values.  It is small however
many positions there are, gives exact average ranks from cumulative weights, and a block of
positions that are zero on both routes is one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def joint_histogram(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, g, t, w) of points (keys, g, t)."""
    return points.groupBy(*keys, "g", "t").agg(F.count("*").alias("w"))


def with_zero_block(hist: DataFrame, keys: list[str], positions: DataFrame) -> DataFrame:
    """hist with a row (0, 0) for the positions of each key that have no value: what the histogram lacks of n_positions.

    positions: n_positions by some of the keys, or one row for all.  The first row of a key brings the block along, so the
    histogram is read once.
    """
    on = [k for k in keys if k in positions.columns]
    key = Window.partitionBy(*keys)
    summed = hist.withColumn("_n", F.sum("w").over(key)).withColumn("_k", F.row_number().over(key.orderBy("g", "t")))
    joined = summed.join(positions, on) if on else summed.join(F.broadcast(positions))
    part = lambda g, t, w: F.struct(g.cast("long").alias("g"), t.cast("long").alias("t"), w.cast("long").alias("w"))
    lack = F.col("n_positions") - F.col("_n")
    block = F.when((F.col("_k") == 1) & (lack > 0), part(F.lit(0), F.lit(0), lack))
    return joined.select(*keys, F.explode(F.array_compact(F.array(part(F.col("g"), F.col("t"), F.col("w")), block))).alias("_r")).select(*keys, "_r.*")


def _weighted_corr(x: Column, y: Column, w: Column) -> tuple[Column, ...]:
    return F.sum(w), F.sum(w * x), F.sum(w * y), F.sum(w * x * x), F.sum(w * y * y), F.sum(w * x * y)


def _corr(name: str) -> Column:
    n, sx, sy, sxx, syy, sxy = (F.col(f"{name}_{k}") for k in ("n", "x", "y", "xx", "yy", "xy"))
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    value = (n * sxy - sx * sy) / F.sqrt(vx * vy)
    # null for two positions or fewer and for a constant side
    return F.when((n > 2) & (vx > 1e-9 * n * F.abs(sxx)) & (vy > 1e-9 * n * F.abs(syy)), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))


def correlations(hist: DataFrame, keys: list[str], more: Sequence[Column] = ()) -> DataFrame:
    """(keys, n, spearman, pearson) of a joint histogram, and ``more`` aggregates of its rows; Pearson is of log2(x + 1).

    Average ranks are windows over the histogram's own rows: the weight up to a value less half its ties.  One
    shuffle by key; rows of equal (g, t) may repeat.
    """
    key = Window.partitionBy(*keys)
    w = F.col("w").cast("double")

    def rank(value: str) -> Column:
        upto = F.sum("w").over(key.orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow))
        return upto - (F.sum("w").over(Window.partitionBy(*keys, value)) - 1) / 2.0

    # centred on the mid rank, which keeps the sums small
    mid = (F.sum("w").over(key) + 1) / 2.0
    both = hist.select("*", (rank("g") - mid).alias("_rg"), (rank("t") - mid).alias("_rt"))
    logs = (F.log2(F.col("g") + 1.0), F.log2(F.col("t") + 1.0))
    sums = []
    for name, (x, y) in (("s", (F.col("_rg"), F.col("_rt"))), ("p", logs)):
        sums += [c.alias(f"{name}_{k}") for k, c in zip(("n", "x", "y", "xx", "yy", "xy"), _weighted_corr(x, y, w), strict=True)]
    found = both.groupBy(*keys).agg(*sums, *more)
    return found.select(*keys, F.col("s_n").cast("long").alias("n"), _corr("s").alias("spearman"), _corr("p").alias("pearson"), *found.columns[len(keys) + len(sums) :])


POPULATIONS = {"inter": "g > 0 AND t > 0", "union": "g > 0 OR t > 0", "all": "true"}


def pooled(points: DataFrame, keys: list[str], positions: DataFrame) -> DataFrame:
    """Counts and six correlations by key over bases covered on both routes, on either, and on all with the zero block.

    The populations are tags on the rows of one histogram, so each route is ranked in one pass.
    """
    hist = with_zero_block(joint_histogram(points, keys), keys, positions)
    tags = F.explode(F.array_compact(F.array(*(F.when(F.expr(when), F.lit(name)) for name, when in POPULATIONS.items())))).alias("population")
    only = lambda when: F.coalesce(F.sum(F.when(F.expr(when), F.col("w"))), F.lit(0))
    sides = {"n_bases_g_only": "g > 0 AND t = 0", "n_bases_t_only": "g = 0 AND t > 0"}
    found = correlations(hist.select(*keys, "g", "t", "w", tags), [*keys, "population"], [only(when).alias(name) for name, when in sides.items()])
    of = lambda name, c: F.max(F.when(F.col("population") == name, F.col(c)))
    return found.groupBy(*keys).agg(
        *(of("all", c).alias(c) for c in sides), *(F.coalesce(of(p, "n"), F.lit(0)).alias(f"n_bases_{p}") for p in POPULATIONS), *(of(p, c).alias(f"{c}_{p}") for p in POPULATIONS for c in ("spearman", "pearson"))
    )


def paired_points(genome: DataFrame, txome: DataFrame, keys: list[str]) -> DataFrame:
    """Sparse points of both routes side by side; absent is 0."""
    g, t = (x.select(*keys, "pos", F.col("n").alias(c)) for x, c in ((genome, "g"), (txome, "t")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return g.join(t, [*keys, "pos"], "full_outer").select(*keys, "pos", zero("g"), zero("t"))


def frame_agreement(points: DataFrame, keys: list[str]) -> DataFrame:
    """Codons covered on both routes, and how many have the same strongest base (ties: the first)."""
    frame, codon = F.pmod(F.col("pos"), F.lit(3)), F.floor(F.col("pos") / 3)
    strongest = lambda c: F.max(F.struct(F.col(c), -F.col("frame"), F.col("frame").alias("f")))["f"]
    per = points.withColumn("frame", frame).withColumn("codon", codon).groupBy(*keys, "transcript_id", "codon").agg(F.sum("g").alias("g"), F.sum("t").alias("t"), strongest("g").alias("fg"), strongest("t").alias("ft"))
    both = per.where("g > 0 AND t > 0").groupBy(*keys).agg(F.count("*").alias("n_codons"), F.count_if(F.col("fg") == F.col("ft")).alias("n_agree"))
    return both.withColumn("frame_agree", F.col("n_agree") / F.col("n_codons"))


def distribution(per_transcript: DataFrame, column: str = "spearman") -> DataFrame:
    """(sample, n, median, place): libraries by ascending median of the coefficient; ties by name.  One row a library."""
    found = per_transcript.groupBy("sample").agg(F.count(column).alias("n"), F.percentile(column, 0.5).alias("median"))
    return found.withColumn("place", F.row_number().over(Window.orderBy("median", "sample")))
