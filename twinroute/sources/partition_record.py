"""The gene partition as a table and a record, written, read back and checked.

A dump has a row a read of a gene; an entry is a gene's counts and shares of the seven segments.  The record is a table with a row a segment
and a JSON text that says which segments there are and what they mean.  Whoever reads it back trusts neither: the JSON is parsed by its schema,
shares are recomputed from the counts, and a gene that does not add up fails inside the query.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinroute.operators.checks import fingerprint, require_columns

TABLE = "sample string, gene_id long, transcript_id long, n_union long, segment_order int, segment_key string, segment_label string, n_reads long, pct_of_union double"
META = "segments array<struct<key: string, label: string>>, semantics map<string, string>, source struct<n_rows: bigint, digest: bigint>"
ENTRY = "gene_id bigint, transcript_id bigint, n_union bigint, counts map<string, bigint>"
_SUM = 1e-9


def _failed(*parts, kind: str = "double"):
    return F.raise_error(F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))).cast(kind)


def _text(c: str):
    return F.coalesce(F.col(c).cast("string"), F.lit("null"))


def entries(dump: DataFrame, segments: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, gene_id, transcript_id, n_union, counts) of a dump (by, gene_id, transcript_id, read_id, segment); counts has every segment.

    A read that a gene has twice and a segment that is not one of the seven fail the query.  A dump with ``n`` instead of read_id is
    counted already.
    """
    keys = [*by, "gene_id", "transcript_id"]
    if "read_id" not in dump.columns:
        return _counted(require_columns(dump, [*keys, "segment", "n"], "dump"), _known("segment", segments), F.col("n"), keys, segments)
    once = require_columns(dump, [*keys, "read_id", "segment"], "dump").groupBy(*keys, "read_id").agg(F.count("*").alias("_k"), F.min("segment").alias("segment"))
    twice = F.when(F.col("_k") > 1, _failed("gene ", _text("gene_id"), ": a read is in the dump more than once", kind="string"))
    return _counted(once, F.coalesce(twice, _known("segment", segments)), F.lit(1), keys, segments)


def _known(c: str, segments: Sequence[str]):
    return F.coalesce(F.when(F.col(c).isin(*segments), F.col(c)), _failed("gene ", _text("gene_id"), ": unknown segment ", _text(c), kind="string"))


def _counted(dump: DataFrame, checked, n, keys: Sequence[str], segments: Sequence[str]) -> DataFrame:
    of = lambda s: F.coalesce(F.sum(F.when(F.col("segment") == s, F.col("_n"))), F.lit(0)).cast("long").alias(s)
    counted = dump.select(*keys, checked.alias("segment"), n.alias("_n")).groupBy(*keys).agg(F.sum("_n").cast("long").alias("n_union"), *(of(s) for s in segments))
    return counted.select(*keys, "n_union", F.create_map(*(x for s in segments for x in (F.lit(s), F.col(s)))).alias("counts"))


def shares(found: DataFrame, segments: Sequence[str]) -> DataFrame:
    """Entries with ``pct`` (a map like counts); segments that differ, counts that miss the union and shares that miss 100 fail the query."""
    total = F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda a, x: a + x)
    names = F.array_sort(F.map_keys("counts"))
    pct = F.map_from_arrays(F.map_keys("counts"), F.transform(F.map_values("counts"), lambda n: F.lit(100.0) * n / F.col("n_union")))
    sure = F.aggregate(F.map_values("_pct"), F.lit(0.0), lambda a, x: a + x)
    gene = _text("gene_id")
    kind = "map<string,double>"
    out = found.withColumn("_pct", pct)
    checked = (
        F.when(names != F.array(*(F.lit(s) for s in sorted(segments))), _failed("gene ", gene, ": segments ", F.array_join(names, ","), kind="string"))
        .when(total != F.col("n_union"), _failed("gene ", gene, ": counts sum to ", total.cast("string"), ", union ", _text("n_union"), kind="string"))
        .when((F.col("n_union") > 0) & (F.abs(sure - 100.0) > _SUM), _failed("gene ", gene, ": shares sum to ", sure.cast("string"), kind="string"))
        .otherwise("")
    )
    return out.withColumn("pct", F.when(checked == "", F.col("_pct")).cast(kind)).drop("_pct")


def to_text(found: DataFrame) -> DataFrame:
    """Entries with their JSON text."""
    return found.withColumn("json", F.to_json(F.struct("gene_id", "transcript_id", "n_union", "counts")))


def from_text(texts: DataFrame, segments: Sequence[str], column: str = "json") -> DataFrame:
    """Entries of JSON texts, parsed by schema and checked; other columns stay.  A text that is none fails the query."""
    parsed = texts.withColumn("_e", F.from_json(column, ENTRY, {"mode": "FAILFAST"}))
    rest = [c for c in texts.columns if c not in ("gene_id", "transcript_id", "n_union", "counts", column)]
    return shares(parsed.select(*rest, "_e.*"), segments)


def tidy(found: DataFrame, labels: Mapping[str, str], by: Sequence[str] = ()) -> DataFrame:
    """A row a segment of checked entries, in the segments' order."""
    parts = F.explode(F.array(*(F.struct(F.lit(k).alias("segment_order"), F.lit(s).alias("segment_key"), F.lit(label).alias("segment_label")) for k, (s, label) in enumerate(labels.items())))).alias("s")
    at = lambda c: F.element_at(c, F.col("s.segment_key"))
    out = found.select(*by, "gene_id", "transcript_id", "n_union", "counts", "pct", parts)
    return out.select(*by, "gene_id", "transcript_id", "n_union", "s.*", at("counts").alias("n_reads"), at("pct").alias("pct_of_union"))


def write(found: DataFrame, path: str, labels: Mapping[str, str], semantics: Mapping[str, str], dump: DataFrame) -> None:
    """Table (tab-separated) and JSON of entries by sample; the JSON carries the dump's row count and digest."""
    tidy(found, labels, ["sample"]).orderBy("sample", "gene_id", "segment_order").write.mode("overwrite").csv(f"{path}/table", sep="\t", header=True)
    segments = F.array(*(F.struct(F.lit(s).alias("key"), F.lit(label).alias("label")) for s, label in labels.items()))
    told = F.create_map(*(F.lit(x) for kv in sorted(semantics.items()) for x in kv))
    one = fingerprint(dump).select(F.to_json(F.struct(segments.alias("segments"), told.alias("semantics"), F.struct(F.col("n").alias("n_rows"), F.col("digest").alias("digest")).alias("source"))).alias("value"))
    one.coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def meta(spark: SparkSession, path: str) -> dict:
    """The record's JSON, parsed by schema; a damaged one is an error."""
    rows = spark.read.text(f"{path}/meta", wholetext=False).select(F.from_json("value", META, {"mode": "FAILFAST"}).alias("m")).select("m.*").collect()  # one row
    if len(rows) != 1 or not rows[0]["segments"]:
        raise ValueError("the record's JSON has no segments")
    return rows[0].asDict(recursive=True)


def load(spark: SparkSession, path: str, genes: Sequence[int] = ()) -> DataFrame:
    """Checked entries (sample, gene_id, transcript_id, n_union, counts, pct) of a record; shares are recomputed, genes asked for have to be there."""
    segments = [s["key"] for s in meta(spark, path)["segments"]]
    table = spark.read.csv(f"{path}/table", sep="\t", header=True, schema=TABLE, mode="FAILFAST")
    keys = ["sample", "gene_id", "transcript_id", "n_union"]
    if genes:
        table = table.where(F.col("gene_id").isin(*genes))
    found = table.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("segment_key", "n_reads")))).alias("counts"))
    if genes:
        asked = spark.createDataFrame([(int(g),) for g in genes], "gene_id long").join(found.select(*keys, "counts"), "gene_id", "left")
        gene = F.when(F.col("n_union").isNull(), _failed("gene ", _text("gene_id"), " is not in the record", kind="bigint")).otherwise(F.col("gene_id"))
        found = asked.select("sample", gene.alias("gene_id"), "transcript_id", "n_union", "counts")
    return shares(found, segments)
