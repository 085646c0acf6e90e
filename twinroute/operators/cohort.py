"""Cohort selection and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinroute.operators.checks import refused
from twinroute.operators.unions import stacked


def top_per_group(scored: DataFrame, group: str, score: str, tie: str, k: int = 1) -> DataFrame:
    order = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def scaled_to_range(values: DataFrame, columns: list[str]) -> DataFrame:
    """min-max scores in [0, 1] as s_<column>; a constant column scores 0.  One row of bounds is broadcast."""
    bounds = values.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    out = values.join(F.broadcast(bounds))
    for c in columns:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        out = out.withColumn(f"s_{c}", F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.lit(0.0)))
    return out.select(*values.columns, *(f"s_{c}" for c in columns))


def weighted_score(values: DataFrame, weights: dict[str, float]) -> DataFrame:
    total = sum((F.col(f"s_{c}") * F.lit(w) for c, w in weights.items()), F.lit(0.0))
    return values.withColumn("score", total)


def without_ties(values: DataFrame) -> DataFrame:
    """values, unless two rows share a score, which leaves no defined choice: then the query fails with the scores."""
    return refused(values, values.groupBy("score").agg(F.count("*").alias("n")).where("n > 1"), "score", "tied scores")


def quartiles(values: DataFrame, column: str | Column, by: list[str] | None = None) -> DataFrame:
    c = F.col(column) if isinstance(column, str) else column
    found = [F.count(c).alias("n"), *(F.percentile(c, q).alias(name) for name, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)))]
    return values.groupBy(*by).agg(*found) if by else values.agg(*found)


def box_stats(values: DataFrame, column: str, by: list[str]) -> DataFrame:
    """5, 25, 50, 75 and 95 % points by group."""
    points = ((5, "p05"), (25, "p25"), (50, "p50"), (75, "p75"), (95, "p95"))
    return values.groupBy(*by).agg(F.count(column).alias("n"), *(F.percentile(column, q / 100).alias(n) for q, n in points))


def assemble_panel(base: DataFrame, drop: DataFrame, add: DataFrame, key: str) -> DataFrame:
    """base without the keys of ``drop``, with the rows of ``add``."""
    return stacked(base.join(drop.select(key), key, "left_anti"), add)


def panel_table(panel: DataFrame, metadata: DataFrame, key: str, unique: list[str], places: dict[str, int]) -> DataFrame:
    """panel with its metadata by key, numbers rounded.

    A key without metadata, and one that a column of ``unique`` has twice, fail the query with all such keys.
    """
    out = panel.join(metadata.withColumn("_known", F.lit(True)), key, "left")
    out = refused(out, out.where("_known IS NULL"), key, "no metadata").drop("_known")
    for c in unique:
        out = refused(out, out.groupBy(c).agg(F.count("*").alias("n")).where(f"n > 1 AND `{c}` IS NOT NULL"), c, f"repeated {c}")
    return out.select(*(F.round(c, places[c]).alias(c) if c in places else F.col(c) for c in out.columns))


def highlights(tests: DataFrame, alpha: float = 0.05, effect: float = 1.0) -> DataFrame:
    """tests with ``highlight``: padj under alpha and an absolute mean over the effect; a null padj is no highlight."""
    return tests.withColumn("highlight", F.coalesce((F.col("padj") < alpha) & (F.abs("mean") > effect), F.lit(False)))


def ranked_band(tests: DataFrame) -> DataFrame:
    """Rank by mean with the interval; ties by id.  One row a transcript."""
    return tests.select("transcript_id", F.row_number().over(Window.orderBy("mean", "transcript_id")).alias("rank"), "mean", "ci_low", "ci_high")


def role_extremes(values: DataFrame, role: str, column: str, key: str, few: str, k: int = 5) -> DataFrame:
    """(role, key, value): the largest absolute value of every role, and of the role ``few`` the k largest; ties: the lesser key."""
    size = F.abs(F.col(column))
    ranked = values.where(F.col(column).isNotNull()).withColumn("place", F.row_number().over(Window.partitionBy(role).orderBy(F.desc(size), key)))
    return ranked.where(F.col("place") <= F.when(F.col(role) == few, k).otherwise(1)).select(role, key, column, "place")


def library_order(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Libraries by ascending difference b - a; ties by name.  One row a library."""
    gap = F.col(b) - F.col(a)
    return pairs.select("sample", gap.alias("difference"), F.row_number().over(Window.orderBy(gap, "sample")).alias("place"))


def cluster_summary(table: DataFrame, flag: str, column: str) -> DataFrame:
    """Per cluster: size, share with the flag, median, quartiles and 5-95 % points of the column."""
    points = ((5, "p05"), (25, "p25"), (50, "p50"), (75, "p75"), (95, "p95"))
    return table.groupBy("cluster").agg(F.count("*").alias("n"), F.avg(F.col(flag).cast("int")).alias("share"), *(F.percentile(column, q / 100).alias(n) for q, n in points))


def pool(values: DataFrame, least_depth: float, least_run: int) -> DataFrame:
    """Candidates that pass the hard filters, with the log10 of the depth."""
    return values.where((F.col("depth") >= least_depth) & (F.col("run") >= least_run)).withColumn("log_depth", F.log10("depth"))
