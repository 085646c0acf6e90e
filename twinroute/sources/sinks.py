"""Sinks: Parquet by default, delimited text and JSON on request, provenance, sparse coverage with its checks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_tsv(df: DataFrame, path: str, order: list[str], gz: bool = True, one_file: bool = False) -> None:
    """Tab-separated text in a fixed order over its part files; ``one_file`` is for tables of a row a sample or gene."""
    ordered = df.orderBy(*order)
    (ordered.coalesce(1) if one_file else ordered).write.mode("overwrite").csv(path, sep="\t", header=True, compression="gzip" if gz else "none", nullValue="")


def write_by_sample(df: DataFrame, path: str, files: int = 8) -> None:
    """Parquet by sample; only the samples in df are replaced, so libraries can be added one at a time."""
    df.repartition("sample", F.pmod(F.xxhash64(*df.columns), F.lit(files))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sample").parquet(path)


def coverage_violations(points: DataFrame, transcripts: DataFrame, signals: list[str]) -> DataFrame:
    """(sample, signal, problem, n) of a coverage table: unknown signals and transcripts, positions out of range, counts not positive, repeated positions."""
    joined = points.join(transcripts.select("transcript_id", "transcript_len"), "transcript_id", "left")
    twice = F.count("*").over(Window.partitionBy("sample", "signal", "transcript_id", "pos")) > 1
    tests = {
        "unknown signal": ~F.col("signal").isin(*signals),
        "unknown transcript": F.col("transcript_len").isNull(),
        "position out of range": (F.col("pos") < 0) | (F.col("pos") >= F.col("transcript_len")),
        "count not positive": F.coalesce(F.col("n") <= 0, F.lit(True)),
        "count over 32 bits": F.col("n") > (1 << 31) - 1,
        "repeated position": F.col("twice"),
    }
    marks = F.array_compact(F.array(*(F.when(t, F.lit(name)) for name, t in tests.items())))
    found = joined.withColumn("twice", twice).select("sample", "signal", F.explode(marks).alias("problem"))
    return found.groupBy("sample", "signal", "problem").agg(F.count("*").alias("n"))


def provenance(spark: SparkSession, inputs: Mapping[str, str], parameters: Mapping[str, str], summaries: Mapping[str, DataFrame]) -> DataFrame:
    """One row: inputs, parameters and row counts with digests of the tables, also as JSON."""
    from twinroute.operators.checks import fingerprint

    rows = None
    for name, df in summaries.items():
        one = fingerprint(df).select(F.lit(name).alias("table"), "n", "digest")
        rows = one if rows is None else rows.unionByName(one)
    tables = rows.agg(F.sort_array(F.collect_list(F.struct("table", "n", "digest"))).alias("tables"))
    as_map = lambda m: F.create_map(*[F.lit(x) for kv in sorted(m.items()) for x in kv])
    out = tables.select(as_map(inputs).alias("inputs"), as_map(parameters).alias("parameters"), "tables")
    return out.withColumn("json", F.to_json(F.struct("inputs", "parameters", "tables")))
