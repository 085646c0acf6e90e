"""Grouping genes by composition with Spark ML.

Bisecting k-means stands in for exact hierarchical linkage, which is a quadratic single-machine
algorithm; the objective (within-cluster sum of squares) is the same, the labels are not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def composition(table: DataFrame, parts: list[str], total: str, key: str) -> DataFrame:
    """key and shares f_<part> that sum to 1, for rows with a positive total."""
    return table.where(F.col(total) > 0).select(key, *((F.col(p) / F.col(total)).alias(f"f_{p}") for p in parts))


def grouped(table: DataFrame, parts: list[str], k: int, seed: int = 7, method: str = "bisecting") -> DataFrame:
    """table with ``cluster``: 1..k by descending centroid of the first part."""
    from pyspark.ml.clustering import BisectingKMeans, KMeans
    from pyspark.ml.feature import VectorAssembler

    points = VectorAssembler(inputCols=[f"f_{p}" for p in parts], outputCol="_x").transform(table)
    model = (BisectingKMeans if method == "bisecting" else KMeans)(k=k, seed=seed, featuresCol="_x", predictionCol="_raw").fit(points)
    labelled = model.transform(points)
    order = labelled.groupBy("_raw").agg(F.avg(f"f_{parts[0]}").alias("_c"))
    names = order.select("_raw", F.row_number().over(Window.orderBy(F.desc("_c"), "_raw")).alias("cluster"))  # k rows
    return labelled.join(F.broadcast(names), "_raw").drop("_x", "_raw")


def quality(table: DataFrame, parts: list[str], ks: range = range(2, 9), seed: int = 7) -> DataFrame:
    """(k, within, between_share, silhouette) over several k; the silhouette is of squared distances."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    points = VectorAssembler(inputCols=[f"f_{p}" for p in parts], outputCol="_x").transform(table).cache()
    total = points.agg(sum((F.var_pop(f"f_{p}") for p in parts), F.lit(0.0)).alias("v"), F.count("*").alias("n")).first()
    rows = []
    for k in ks:
        model = BisectingKMeans(k=k, seed=seed, featuresCol="_x").fit(points)
        made = model.transform(points)
        within = float(model.summary.trainingCost)
        rows.append((k, within, 1 - within / (total["v"] * total["n"]) if total["v"] else None, float(ClusteringEvaluator(featuresCol="_x").evaluate(made))))
    points.unpersist()
    return table.sparkSession.createDataFrame(rows, "k int, within double, between_share double, silhouette double")


def centroids(labelled: DataFrame, parts: list[str]) -> DataFrame:
    """Member means in percent, sizes, and the part that dominates each cluster."""
    means = labelled.groupBy("cluster").agg(F.count("*").alias("n_genes"), *((F.avg(f"f_{p}") * 100).alias(f"pct_{p}") for p in parts))
    best = F.array_max(F.array(*(F.struct(F.col(f"pct_{p}").alias("v"), F.lit(p).alias("part")) for p in parts)))["part"]
    return means.withColumn("dominant", best)


def same_partition(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: whether two labellings are the same up to names."""
    pairs = a.select(key, F.col("cluster").alias("x")).join(b.select(key, F.col("cluster").alias("y")), key).select("x", "y").distinct()
    return pairs.agg(((F.count("*") == F.count_distinct("x")) & (F.count("*") == F.count_distinct("y"))).alias("same"))
