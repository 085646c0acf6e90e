"""Alignment scans: raw records of either route to the rows that every operator takes.

Raw records have sample, read_id, flag, ref, pos, epos (half-open), strand, qlen, mapq, nh, score and cigar, whatever
they were read from.  Flags are judged here once: unmapped and supplementary records never go on, secondary
ones only on the genome route, and a primary of that route without NH stops the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinroute.functions.columns import NOT_PRIMARY, SECONDARY, SUPPLEMENTARY, UNMAPPED, base_id, flag_set, is_primary, is_unique_genome, is_unique_transcriptome, walk

# Fixed names of what a record is by its flag; the first that holds.
KINDS = ("unmapped", "supplementary", "secondary", "primary")


def kind(flag: Column) -> Column:
    out = F
    for bits, name in zip((UNMAPPED, SUPPLEMENTARY, SECONDARY), KINDS, strict=False):
        out = out.when(flag_set(flag, bits), name)
    return out.otherwise(KINDS[-1])


def audit(records: DataFrame) -> DataFrame:
    """Per sample: records by kind, primaries without NH, unique primaries and reads with a supplementary record."""
    named = records.withColumn("kind", kind(F.col("flag")))
    primary = F.col("kind") == "primary"
    per_read = named.groupBy("sample", "read_id").agg(
        F.count("*").alias("n_records"), *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS),
        F.count_if(primary & F.col("nh").isNull()).alias("n_no_nh"), F.count_if(is_unique_genome(F.col("flag"), F.col("nh"))).alias("n_unique"),
    )
    sums = ["n_records", *(f"n_{k}" for k in KINDS), "n_no_nh", "n_unique"]
    return per_read.groupBy("sample").agg(
        F.count("*").alias("n_reads"), *(F.sum(c).alias(c) for c in sums), F.count_if(F.col("n_supplementary") > 0).alias("n_split_reads"), F.count_if(F.col("n_primary") > 1).alias("n_repeated_primaries")
    )


def genome(records: DataFrame) -> DataFrame:
    """Rows of the genome route as the operators take them: primaries and secondaries with aligned blocks.

    A primary without NH is an error: uniqueness is never guessed from the mapping quality.
    """
    absent = F.raise_error(F.concat(F.lit("genome alignment without NH: "), F.col("read_id").cast("string"))).cast("int")
    nh = F.when(is_primary(F.col("flag")) & F.col("nh").isNull(), absent).otherwise(F.col("nh"))
    runs = F.transform(walk(F.col("pos"), F.col("cigar")), lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end")))
    kept = records.where(~flag_set(F.col("flag"), UNMAPPED | SUPPLEMENTARY))
    return kept.select("sample", "read_id", F.col("ref").alias("chrom"), "pos", "epos", "strand", "qlen", "score", nh.alias("nh"), flag_set(F.col("flag"), SECONDARY).alias("is_secondary"), "flag", "cigar", joined(runs).alias("blocks"))


def joined(runs: Column) -> Column:
    """Runs (start, end) with touching ones as one: insertions do not part a block, gaps do."""
    first = F.slice(runs, 1, 1)
    last = lambda done: F.element_at(done, -1)
    grow = lambda done, r: F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last(done)["start"].alias("start"), r["end"].alias("end"))))
    return F.aggregate(F.slice(runs, F.lit(2), F.greatest(F.size(runs) - 1, F.lit(0))), first, lambda done, r: F.when(last(done)["end"] == r["start"], grow(done, r)).otherwise(F.concat(done, F.array(r))))


def checked_references(header: DataFrame, transcripts: DataFrame, shown: int = 10) -> DataFrame:
    """(ref, transcript_id, transcript_len) of the references (ref, length) that name a transcript by its base id.

    Both routes must be on one ruler: if any such reference has another length than its transcript, or its base id is that of several
    transcripts, the query fails with the number of them and the first ``shown``.  References of no transcript are left out.
    """
    known = transcripts.select(base_id(F.col("transcript_id").cast("string")).alias("_base"), "transcript_id", "transcript_len")
    named = header.select("ref", "length").distinct().withColumn("_base", base_id(F.split("ref", "[|]")[0]))
    met = named.join(known, "_base")
    per = met.groupBy("ref", "length").agg(F.count("*").alias("n"), F.min("transcript_id").alias("transcript_id"), F.min("transcript_len").alias("transcript_len"))
    wrong = per.where((F.col("n") > 1) | (F.col("length") != F.col("transcript_len")))
    told = F.when(F.col("n") > 1, F.lit("several transcripts")).otherwise(F.concat_ws(" ", F.col("length").cast("string"), F.lit("instead of"), F.col("transcript_len").cast("string")))
    # the least names without sorting all faults in one task
    first = F.slice(F.sort_array(F.collect_list(F.concat_ws(": ", "ref", told))), 1, shown)
    faults = wrong.withColumn("_part", F.pmod(F.xxhash64("ref"), F.lit(64))).groupBy("_part").agg(F.count("*").alias("k"), first.alias("some"))
    fault = faults.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("_faults"), F.slice(F.sort_array(F.flatten(F.collect_list("some"))), 1, shown).alias("_some"))
    failed = F.raise_error(F.concat(F.col("_faults").cast("string"), F.lit(" references do not fit their transcripts: "), F.array_join("_some", ", ")))
    # one row
    return per.join(F.broadcast(fault)).select("ref", F.when(F.col("_faults") > 0, failed.cast(per.schema["transcript_id"].dataType)).otherwise(F.col("transcript_id")).alias("transcript_id"), "transcript_len")


def transcriptome(records: DataFrame, references: DataFrame) -> DataFrame:
    """Primaries of the transcriptome route with transcript_id (null where the reference is none's) and ``confident`` by mapping quality."""
    kept = records.where(~flag_set(F.col("flag"), NOT_PRIMARY)).withColumn("confident", is_unique_transcriptome(F.col("flag"), F.col("mapq")))
    return kept.join(references, "ref", "left").select("sample", "read_id", "transcript_id", "ref", "pos", "epos", "qlen", "mapq", "confident", "transcript_len")


def route_counts(rows: DataFrame) -> DataFrame:
    """Per sample of ``transcriptome`` rows: primaries, confident ones, resolved ones, and resolved confident ones that reach past their transcript."""
    known = F.col("transcript_id").isNotNull()
    return rows.groupBy("sample").agg(
        F.count("*").alias("n_primary"), F.count_if("confident").alias("n_confident"), F.count_if(known).alias("n_resolved"), F.count_if(known & F.col("confident")).alias("n_used"),
        F.count_if(known & F.col("confident") & (F.col("epos") > F.col("transcript_len"))).alias("n_overhanging"),
    )
