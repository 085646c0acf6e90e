"""Checks as violation queries: an empty result passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinroute.functions.columns import base_id, is_primary


def require_columns(df: DataFrame, names: list[str], source: str) -> DataFrame:
    """df, or an error that lists every missing name."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{source}: missing columns {', '.join(missing)}")
    return df


def table_diff(a: DataFrame, b: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Rows that differ: key, status (only_left, only_right, differs) and the names of differing columns."""
    left = a.select(*key, F.struct(*values).alias("l"))
    right = b.select(*key, F.struct(*values).alias("r"))
    both = left.join(right, key, "full_outer")
    names = F.array_compact(F.array(*(F.when(~F.col(f"l.{v}").eqNullSafe(F.col(f"r.{v}")), F.lit(v)) for v in values)))
    status = F.when(F.col("r").isNull(), "only_left").when(F.col("l").isNull(), "only_right").otherwise("differs")
    found = both.where(~F.col("l").eqNullSafe(F.col("r")))
    return found.select(*key, status.alias("status"), F.array_join(F.when(status == "differs", names).otherwise(F.array().cast("array<string>")), ",").alias("columns"))


def column_differences(a: DataFrame, b: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Per column, how many common rows differ."""
    left = a.select(*key, *(F.col(v).alias(f"l_{v}") for v in values))
    right = b.select(*key, *(F.col(v).alias(f"r_{v}") for v in values))
    both = left.join(right, key)
    counted = both.agg(*(F.count_if(~F.col(f"l_{v}").eqNullSafe(F.col(f"r_{v}"))).alias(v) for v in values))
    return counted.select(F.explode(F.array(*(F.struct(F.lit(v).alias("column"), F.col(v).alias("n_differ")) for v in values))).alias("c")).select("c.*")


def missing_nh(aln: DataFrame) -> DataFrame:
    """Primaries without NH by sample: an error, never decided by mapping quality."""
    return aln.where(is_primary(F.col("flag")) & F.col("nh").isNull()).groupBy("sample").agg(F.count("*").alias("n"))


def paired_end(aln: DataFrame) -> DataFrame:
    """Samples with any paired read."""
    return aln.groupBy("sample").agg(F.bool_or(F.col("flag").bitwiseAND(F.lit(1)) != 0).alias("paired")).where("paired").select("sample")


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def unknown_values(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    return df.where(F.col(column).isNull() | ~F.col(column).isin(allowed)).groupBy(column).agg(F.count("*").alias("n"))


def partition_of(df: DataFrame, parts: list[str], total: str) -> Column:
    """Whether the parts of a row sum to its total."""
    return reduce(lambda x, y: x + y, (F.col(p) for p in parts)) == F.col(total)


def refused(rows: DataFrame, faults: DataFrame, label: str, said: str, shown: int = 10) -> DataFrame:
    """rows as they are, unless ``faults`` has rows: then the query fails with their number and the first ``shown`` labels."""
    few = faults.select(F.col(label).cast("string").alias("_l")).withColumn("_part", F.pmod(F.xxhash64("_l"), F.lit(64))).groupBy("_part")
    parts = few.agg(F.count("*").alias("k"), F.slice(F.sort_array(F.collect_set("_l")), 1, shown).alias("some"))
    one = parts.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("_k"), F.slice(F.sort_array(F.flatten(F.collect_list("some"))), 1, shown).alias("_some"))
    fault = F.raise_error(F.concat(F.lit(f"{said}: "), F.col("_k").cast("string"), F.lit(" ("), F.array_join("_some", ", "), F.lit(")"))).cast("boolean")
    # one row; the test stands in a filter, so no consumer can do without it
    return rows.join(F.broadcast(one)).where(F.when(F.col("_k") > 0, fault).otherwise(F.lit(True))).drop("_k", "_some")


def fingerprint(df: DataFrame) -> DataFrame:
    """One row (n, digest) that does not depend on row order or partitions: sums and xor of row hashes."""
    row = F.xxhash64(*df.columns)
    return df.agg(F.count("*").alias("n"), F.bit_xor(row).alias("digest"), F.sum(F.pmod(row, F.lit(1 << 31))).alias("total"))


def reference_map_violations(header: DataFrame, transcripts: DataFrame) -> DataFrame:
    """References (name, length) that do not map to exactly one transcript (transcript_id, transcript_len) of the same length, by base id."""
    known = transcripts.select(base_id(F.col("transcript_id")).alias("_base"), F.col("transcript_len").alias("_len"))
    found = header.withColumn("_base", base_id(F.col("name"))).join(known, "_base", "left").groupBy("name", "length").agg(F.count("_len").alias("n"), F.min("_len").alias("known"))
    problem = F.when(F.col("n") == 0, "unknown_reference").when(F.col("n") > 1, "ambiguous_reference").when(F.col("known") != F.col("length"), "length_differs")
    return found.select("name", "length", F.col("known").alias("expected"), problem.alias("problem")).where("problem IS NOT NULL")


def universe_counts(header: DataFrame, annotation: DataFrame) -> DataFrame:
    """One row: transcripts on both sides and on either one only, and genes with several transcripts in common."""
    a, b = header.select("transcript_id").distinct(), annotation.select("transcript_id", "gene_id").distinct()
    both = b.join(a, "transcript_id", "left_semi")
    side = a.select("transcript_id", F.lit(1).alias("h")).join(b.select("transcript_id", F.lit(1).alias("k")).distinct(), "transcript_id", "full_outer")
    several = both.groupBy("gene_id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n_genes_with_several"))
    return side.agg(F.count_if(F.col("h").isNotNull() & F.col("k").isNotNull()).alias("n_shared"), F.count_if(F.col("k").isNull()).alias("n_header_only"), F.count_if(F.col("h").isNull()).alias("n_annotation_only")).join(F.broadcast(several))  # one row each


def label_violations(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys whose label is absent from or differs in the other table."""
    return table_diff(a, b, [key], ["cluster"])
