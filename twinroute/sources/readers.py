"""Scans: alignments as Parquet or SAM text, GTF, reference headers, BED, manifests, delimited tables.

Each file is read once with a declared schema; consumers filter and project the one table,
so column pruning and pushed filters decide what is read.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinroute.functions.columns import REGION_LABELS, base_id, sample_of_path, strand_of, walk
from twinroute.operators.checks import require_columns
from twinroute.operators.unions import stacked
from twinroute.sources import schemas


def alignments(spark: SparkSession, path: str) -> DataFrame:
    """Raw records as Parquet, best laid out by sample and reference and sorted by position."""
    return spark.read.schema(schemas.ALIGNMENT).parquet(path)


def sam_text(spark: SparkSession, path: str, suffix: str = ".sam") -> DataFrame:
    """SAM text as raw records: 0-based pos, epos from the CIGAR, strand, NH and AS tags (null if absent), sample from the file name."""
    found = F.split("value", "\t")
    text = spark.read.text(path).where(~F.col("value").startswith("@"))
    named = [F.get(found, F.lit(k)).cast(f.dataType).alias(f.name) for k, f in enumerate(schemas.SAM_LINE)]
    # every optional field, however many
    rest = F.array_join(F.slice(found, len(named) + 1, F.greatest(F.size(found) - len(named), F.lit(0))), "\t")
    lines, tags = text.select(*named, rest.alias("tags")), F.col("tags")
    tag = lambda name: F.nullif(F.regexp_extract(tags, rf"(?:^|\t){name}:i:(-?[0-9]+)", 1), F.lit("")).cast("int")
    start = F.col("pos") - 1
    runs = walk(start, F.col("cigar"))
    return lines.select(
        sample_of_path(F.input_file_name(), suffix).alias("sample"), F.col("qname").alias("read_id"), "flag", F.col("rname").alias("ref"), start.alias("pos"),
        F.coalesce(F.array_max(F.transform(runs, lambda r: r["end"])), start).alias("epos"), strand_of(F.col("flag")).alias("strand"),
        F.length("seq").cast("int").alias("qlen"), "mapq", tag("NH").alias("nh"), tag("AS").alias("score"), "cigar",
    )


def sam_references(spark: SparkSession, path: str) -> DataFrame:
    """(ref, length) of the @SQ lines of SAM text."""
    lines = spark.read.text(path).where(F.col("value").startswith("@SQ\t"))
    field = lambda name: F.nullif(F.regexp_extract("value", rf"\t{name}:([^\t]*)", 1), F.lit(""))
    return lines.select(field("SN").alias("ref"), field("LN").try_cast("long").alias("length")).distinct()


def attribute(name: str) -> Column:
    return F.nullif(F.regexp_extract("attributes", rf'(?:^|;)\s*{name} "([^"]*)"', 1), F.lit(""))


def gtf(spark: SparkSession, path: str, features: tuple[str, ...] = (), extra: tuple[str, ...] = ()) -> DataFrame:
    """GTF features with ids and types taken from the attributes; start moves to 0-based."""
    lines = spark.read.csv(path, sep="\t", schema=schemas.GTF_LINE, comment="#", quote="")
    if features:
        lines = lines.where(F.col("feature").isin(*features))
    names = ("gene_id", "transcript_id", "gene_name", *extra)
    kind = F.coalesce(attribute("gene_type"), attribute("gene_biotype"))
    return lines.select(
        F.col("seqname").alias("chrom"), "feature", (F.col("start") - 1).alias("g_start"), F.col("end").alias("g_end"), "strand",
        F.nullif("phase", F.lit(".")).cast("int").alias("phase"), *(attribute(n).alias(n) for n in names), kind.alias("gene_type"),
    )


def stop_codon_transcripts(features: DataFrame) -> DataFrame:
    return features.where("feature = 'stop_codon'").select("transcript_id").distinct()


def consensus_pseudogenes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pseudogenes with parent_id, rows without a parent)."""
    rows = gtf(spark, path, extra=("parent_id",))
    return rows.where("parent_id IS NOT NULL"), rows.where("parent_id IS NULL")


def headers(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(reference table, quarantine) of pipe-delimited headers.

    Spans become 0-based half-open; a header without the eight fields or with a length that is no number is quarantined with its text.
    """
    parts = F.split(F.regexp_replace(F.split(F.col(column), "\t")[0], "^>", ""), "[|]")
    span = lambda label: F.regexp_extract(column, rf"\|{label}:([0-9]+)-([0-9]+)\|", 1), lambda label: F.regexp_extract(column, rf"\|{label}:([0-9]+)-([0-9]+)\|", 2)
    first, last = span
    bound = lambda f, label: F.nullif(f(label), F.lit("")).cast("long")
    out = lines.withColumn("_p", parts).withColumn("_len", F.get("_p", F.lit(6)).try_cast("long"))
    ok = (F.size("_p") >= 8) & F.col("_len").isNotNull()
    columns = [F.get("_p", F.lit(k)).alias(n) for k, n in ((0, "transcript_id"), (1, "gene_id"), (4, "transcript_name"), (5, "gene_name"))]
    spans = [x for label in REGION_LABELS for x in ((bound(first, label) - 1).alias(f"{label.lower()}_start"), bound(last, label).alias(f"{label.lower()}_end"))]
    good = out.where(ok).select(*columns, base_id(F.get("_p", F.lit(0))).alias("base_id"), F.col("_len").alias("transcript_len"), *spans)
    return good, out.where(~F.coalesce(ok, F.lit(False))).select(column)


def regions_bed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(regions, rows with an unknown label)."""
    rows = spark.read.csv(path, sep="\t", schema=schemas.BED_LINE, comment="#")
    known = F.col("label").isin(*REGION_LABELS)
    return rows.where(known), rows.where(~known)


def delimited(spark: SparkSession, path: str, names: list[str], sep: str = "\t") -> DataFrame:
    """A headed text table (plain or compressed) that must have the columns; every value as text."""
    return require_columns(spark.read.csv(path, sep=sep, header=True), names, path)


def qc_master(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schemas.QC_MASTER)


def manifest_paths(manifest: DataFrame, roles: Mapping[str, str | None], root: str = "") -> DataFrame:
    """(sample_id, role, path) of every sample and role.

    A path that is not absolute lies below ``root``; where the manifest has none, the role's template takes its place (``{sample}`` in it is the
    sample id), or the path is null where there is no template either.
    """
    rows = manifest.select("sample_id", F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.nullif(F.trim(F.col(r)), F.lit("")).alias("given"), F.lit(t).cast("string").alias("template")) for r, t in roles.items()))).alias("f")).select("sample_id", "f.*")
    value = F.coalesce("given", F.replace("template", F.lit("{sample}"), F.col("sample_id")))
    absolute = value.rlike("^(/|[A-Za-z][A-Za-z0-9+.-]*:)")
    below = F.concat(F.lit(root.rstrip("/") + "/"), value) if root else value
    return rows.select("sample_id", "role", F.when(absolute, value).otherwise(below).alias("path"))


def manifest_problems(manifest: DataFrame, files: DataFrame, paths: list[str] | Mapping[str, str | None], version: str, root: str = "") -> DataFrame:
    """Every problem of a cohort manifest at once: (sample_id, problem).  ``paths``: the roles, with their templates if any.

    files: (path, length) of what exists, as the binaryFile source lists it without reading contents; that
    source leaves out files without a byte.
    """
    roles = paths if isinstance(paths, Mapping) else dict.fromkeys(paths)
    rows = manifest.select("sample_id", "schema_version")
    wrong = rows.where(F.col("schema_version").isNull() | (F.col("schema_version") != version)).select("sample_id", F.lit("schema version").alias("problem"))
    empty = rows.where("sample_id IS NULL OR trim(sample_id) = ''").select("sample_id", F.lit("empty sample id").alias("problem"))
    twice = rows.groupBy("sample_id").agg(F.count("*").alias("n")).where("n > 1 AND sample_id IS NOT NULL").select("sample_id", F.lit("duplicate sample id").alias("problem"))
    asked = manifest_paths(manifest, roles, root)
    unnamed = asked.where("path IS NULL").select("sample_id", F.concat(F.lit("no "), "role").alias("problem"))
    known = files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length")
    found = asked.join(known, "path", "left")
    missing = found.where("path IS NOT NULL AND (length IS NULL OR length = 0)").select("sample_id", F.concat(F.lit("missing or empty "), "role").alias("problem"))
    return stacked(wrong, empty, twice, unnamed, missing)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files below a path; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of small files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def resolve_ids(asked: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved, refused): ids (asked) matched exactly, else without version; ambiguous and unknown ones are refused with the candidates."""
    exact = asked.join(known.select(F.col("id").alias("asked"), F.col("id").alias("found")), "asked")
    rest = asked.join(exact, "asked", "left_anti").withColumn("base", base_id(F.col("asked")))
    near = rest.join(known.select(base_id(F.col("id")).alias("base"), "id"), "base", "left").groupBy("asked").agg(F.count("id").alias("n"), F.array_sort(F.collect_list("id")).alias("candidates"))
    one = near.where("n = 1").select("asked", F.get("candidates", F.lit(0)).alias("found"))
    return exact.unionByName(one), near.where("n <> 1").select("asked", "candidates")
