"""Coverage as a table bucketed and sorted by transcript, with a footer that is read before any coverage.

A store is a folder: ``runs`` (run-length segments by sample, bucketed and sorted by transcript), ``transcripts`` and ``footer`` (one
JSON row: layout version, coordinate system, sizes, signals, trim, provenance).  One transcript is one bucket of every sample, and the row
groups' bounds skip the rest of it; joins on transcript_id between stores of one bucket number need no shuffle.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinroute.operators.locus import SIGNALS
from twinroute.operators.unions import stacked

LAYOUT, COORDINATES, ASSAYS = "coverage-runs/1", "spliced transcript, 0-based half-open", ("ribo", "rna")
FOOTER = "layout string, coordinates string, assay string, trim int, buckets int, n_transcripts long, n_positions long, signals array<string>, id_type string, provenance string"
_REQUIRED = [x.split()[0] for x in FOOTER.split(", ")]


def _register(spark: SparkSession, path: str, buckets: int, id_type: str) -> str:
    name = f"coverage_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {name} (signal STRING, transcript_id {id_type}, start BIGINT, `end` BIGINT, depth BIGINT, sample STRING) USING parquet PARTITIONED BY (sample) "
        f"CLUSTERED BY (transcript_id) SORTED BY (transcript_id, signal, start) INTO {int(buckets)} BUCKETS LOCATION '{path}/runs'"
    )
    return name


def write(segments: DataFrame, transcripts: DataFrame, path: str, assay: str, trim: int, provenance: str = "{}", buckets: int = 64) -> None:
    """segments: sample, signal, transcript_id, start, end, depth; transcripts: transcript_id, transcript_len, cds_start, cds_end.

    Rows are dealt by the hash that names the buckets, so each bucket of a sample is one file.  Samples in segments replace their own
    partitions; the others stay.
    """
    spark = segments.sparkSession
    id_type = segments.schema["transcript_id"].dataType.simpleString()
    name = _register(spark, path, buckets, id_type)
    rows = segments.select("signal", "transcript_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("depth").cast("long").alias("depth"), "sample")
    held = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    try:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        rows.repartition(buckets, "transcript_id").write.insertInto(name, overwrite=True)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", held)
        spark.sql(f"DROP TABLE {name}")
    transcripts.select("transcript_id", "transcript_len", "cds_start", "cds_end").write.mode("overwrite").parquet(f"{path}/transcripts")
    sizes = transcripts.agg(F.count("*").alias("n_transcripts"), F.coalesce(F.sum("transcript_len"), F.lit(0)).alias("n_positions"))
    fixed = {"layout": LAYOUT, "coordinates": COORDINATES, "assay": assay, "trim": trim, "buckets": buckets, "signals": list(SIGNALS), "id_type": id_type, "provenance": provenance}
    # one row
    whole = sizes.select(*(F.array(*(F.lit(x) for x in v)).alias(k) if isinstance(v, list) else F.lit(v).alias(k) for k, v in fixed.items()), "n_transcripts", "n_positions")
    whole.coalesce(1).write.mode("overwrite").json(f"{path}/footer")


def footer(spark: SparkSession, path: str) -> dict:
    """The footer row; missing fields are None."""
    rows = spark.read.schema(FOOTER).json(f"{path}/footer").head(1)
    return rows[0].asDict() if rows else {}


def open_runs(spark: SparkSession, path: str) -> DataFrame:
    """The segments of a store as a bucketed table; a store of another layout is refused before its data are touched."""
    found = footer(spark, path)
    if found.get("layout") != LAYOUT:
        raise ValueError(f"layout is {found.get('layout')!r}, expected {LAYOUT!r}")
    name = _register(spark, path, found["buckets"], found["id_type"])
    spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name)


def track(runs: DataFrame, transcript_id, samples: Sequence[str] = ()) -> DataFrame:
    """One transcript's segments: a bucket a sample is read."""
    here = runs.where(F.col("transcript_id") == transcript_id)
    return here.where(F.col("sample").isin(*samples)) if samples else here


def problems(spark: SparkSession, path: str) -> DataFrame:
    """(problem, n) of a store, all at once; nothing but the footer is read where the footer is wrong."""
    found = footer(spark, path)
    early = []
    if found.get("layout") != LAYOUT:
        early.append(f"layout is {found.get('layout')!r}")
    else:
        early += [f"footer lacks {x}" for x in _REQUIRED if found.get(x) is None]
        if found.get("coordinates") not in (None, COORDINATES):
            early.append("other coordinate system")
        if found.get("assay") not in (None, *ASSAYS):
            early.append("unknown assay")
        try:
            json.loads(found.get("provenance") or "{}")
        except ValueError:
            early.append("provenance is no JSON")
    if early:
        return spark.createDataFrame([(x, 1) for x in early], "problem string, n long")
    transcripts = spark.read.parquet(f"{path}/transcripts")
    return stacked(transcript_problems(transcripts, found["n_transcripts"], found["n_positions"]), run_problems(open_runs(spark, path), transcripts, found["signals"]))


def transcript_problems(transcripts: DataFrame, n_transcripts: int, n_positions: int) -> DataFrame:
    """Sizes against the footer, repeated ids and CDS bounds."""
    bad = F.col("cds_start").isNotNull() & ((F.col("cds_start") < 0) | (F.col("cds_end") < F.col("cds_start")) | (F.col("cds_end") > F.col("transcript_len")))
    half = F.col("cds_start").isNull() != F.col("cds_end").isNull()
    per = transcripts.groupBy("transcript_id").agg(F.count("*").alias("k"), F.sum("transcript_len").alias("len"), F.count_if(bad).alias("bad"), F.count_if(half).alias("half"), F.count_if(F.col("transcript_len") <= 0).alias("empty"))
    one = per.agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("k"), F.coalesce(F.sum("len"), F.lit(0)).alias("len"), F.count_if(F.col("k") > 1).alias("repeated transcript"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in (("bad", "CDS off the transcript"), ("half", "half a CDS"), ("empty", "empty transcript"))),
    )
    counts = {
        "number of transcripts differs": F.abs(F.col("k") - n_transcripts),
        "number of positions differs": F.abs(F.col("len") - n_positions),
        **{x: F.col(f"`{x}`") for x in ("repeated transcript", "CDS off the transcript", "half a CDS", "empty transcript")},
    }
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("problem"), v.cast("long").alias("n")) for k, v in counts.items()))).alias("p")
    return one.select(rows).select("p.*").where("n > 0")


def run_problems(runs: DataFrame, transcripts: DataFrame, signals: Sequence[str]) -> DataFrame:
    """Segments of unknown signals or transcripts, empty, off the transcript, without depth, over 32 bits or over each other."""
    joined = runs.join(transcripts.select("transcript_id", "transcript_len"), "transcript_id", "left")
    order = Window.partitionBy("transcript_id", "sample", "signal").orderBy("start", "end")
    tests = {
        "unknown signal": ~F.col("signal").isin(*signals),
        "unknown transcript": F.col("transcript_len").isNull(),
        "empty segment": F.col("end") <= F.col("start"),
        "segment off the transcript": (F.col("start") < 0) | (F.col("end") > F.col("transcript_len")),
        "depth not positive": F.coalesce(F.col("depth") <= 0, F.lit(True)),
        "depth over 32 bits": F.col("depth") > (1 << 31) - 1,
        "segments overlap": F.col("start") < F.col("_before"),
    }
    marks = F.array_compact(F.array(*(F.when(t, F.lit(name)) for name, t in tests.items())))
    return joined.withColumn("_before", F.lag("end").over(order)).select(F.explode(marks).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))
