"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is embedded as the bit counts of its 16 four-bit segments.  The
Manhattan distance of two embeddings never exceeds the Hamming distance of the
fingerprints, so fingerprints at most two bits apart lie within Manhattan distance 2 and
share a grid cell once each is entered in its own cell and in those one step away
(33 cells at most).  This is the range join; a cell whose entries are all one fingerprint
is dropped by a pre-aggregated (min, max).  In the other cells the candidates are verified
exactly without forming pairs: each entry names the words of the cell that are at most one bit from its
fingerprint, and two fingerprints differ in two bits or fewer if and only if they name a
word in common.  At most 65 fingerprints can name a word, so a verified group is small
however many near copies there are, and it is linked as a star.

Defined results: null text counts as empty (fingerprint zero, linked like any other); rows
that repeat an id are linked like other rows; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import similar_sets
from .components import components
from .tables import materialise, sent_if_small, table, text_and_id

SEED = 42
SEGMENTS, SEGMENT_BITS = 16, 4
#: Words of one text whose shingles are hashed at once.
BLOCK_WORDS = 1 << 16


def fingerprint(text: bytes, shingle: int) -> int:
    """SimHash of the word shingles, repeats included: a bit is set where over half of the hashes set it."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxh64_intdigest(b" ".join(words), SEED)
    n = len(words) - shingle + 1
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK_WORDS):
        block = words[at : min(at + BLOCK_WORDS, n) + shingle - 1]
        joined = zip(*(block[k:] for k in range(shingle)), strict=False)
        hashes = np.array([xxh64_intdigest(b" ".join(s), SEED) for s in joined], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            found = np.array([fingerprint(t.as_py() or b"", shingle) for t in texts], dtype=np.uint64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return text_and_id(docs).mapInArrow(run, "doc_id long, fp long")


def _counts(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the segments: (n, 16)."""
    nibbles = (fp[:, None] >> (np.arange(SEGMENTS, dtype=np.uint64) * np.uint64(SEGMENT_BITS))) & np.uint64(15)
    return np.array([bin(x).count("1") for x in range(16)], dtype=np.int64)[nibbles.astype(np.int64)]


def _home(counts: np.ndarray) -> np.ndarray:
    return (counts << (3 * np.arange(SEGMENTS))).sum(axis=1)


def cells(classes: DataFrame) -> DataFrame:
    """(cell, fp): each fingerprint in its own grid cell and in those one step away."""

    def run(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for part in np.array_split(fp, len(fp) // 4096 + 1):
                counts = _counts(part)
                home = _home(counts)
                where, who = [home], [part]
                for s in range(SEGMENTS):
                    for step, fits in ((1, counts[:, s] < SEGMENT_BITS), (-1, counts[:, s] > 0)):
                        where.append(home[fits] + (step << (3 * s)))
                        who.append(part[fits])
                yield pa.record_batch([pa.array(np.concatenate(where)), pa.array(np.concatenate(who).view(np.int64))], names=["cell", "fp"])

    return classes.select("fp").mapInArrow(run, "cell long, fp long")


def words_of_cell(entries: DataFrame) -> DataFrame:
    """(word, fp): the 64-bit words in the entry's cell that are at most one bit from its fingerprint."""

    def run(batches):
        one = np.uint64(1)
        for batch in batches:
            cell = batch.column("cell").to_numpy(zero_copy_only=False)
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            home = _home(_counts(fp))
            words, who = [fp[cell == home]], [fp[cell == home]]
            step = cell - home
            for bit in range(64):
                unit = 1 << (3 * (bit // SEGMENT_BITS))
                on = (fp >> np.uint64(bit)) & one == one
                reach = np.where(on, step == -unit, step == unit)
                words.append(fp[reach] ^ (one << np.uint64(bit)))
                who.append(fp[reach])
            yield pa.record_batch([pa.array(np.concatenate(words).view(np.int64)), pa.array(np.concatenate(who).view(np.int64))], names=["word", "fp"])

    return entries.mapInArrow(run, "word long, fp long")


def links(classes: DataFrame) -> DataFrame:
    """Links (a, b) that connect every two distinct fingerprints at most two bits apart."""
    entered = cells(classes)
    shared = entered.groupBy("cell").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo != hi").select("cell")
    candidates = entered.join(shared, "cell", "left_semi")
    stars = words_of_cell(candidates).groupBy("word").agg(F.collect_list("fp").alias("near")).where(F.size("near") > 1)
    return stars.select(F.array_min("near").alias("a"), F.explode("near").alias("b")).where("a != b").distinct()


def groups(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp and component_id (the smallest id reachable over links) of every row."""
    marked = materialise(fingerprints(docs, shingle))
    classes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(classes))
    joined = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = joined.join(least, "root").select("fp", "component_id")
    return marked.join(of_class, "fp").select("doc_id", "fp", "component_id")


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """docs without those that a smaller id of their group stands for, all columns unchanged.

    Groups join texts whose sets of word shingles have a similarity of 0.8 or more.  Texts whose fingerprints the grid links
    are the first candidates and are verified on their sets; fingerprints of similar texts are often more than two bits
    apart, so ``similar_sets`` finds the links that are left.  Of each group the rows of its least (id, set) stay; rows without an id stay.
    An id that several texts carry is judged text by text, so no group goes without a row that stays.
    """
    found = similar_sets.groups(docs, shingle, fingerprint, links)
    per = found.groupBy("doc_id").agg(F.bool_and("first").alias("all_stay"), F.bool_or("first").alias("some_stay")).where("NOT all_stay")
    gone, _ = sent_if_small(per.select(F.col("doc_id").alias("_gone")))
    kept = docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    mixed = per.where("some_stay").select(F.col("doc_id").alias("_mixed"))
    if mixed.isEmpty():
        return kept
    # an id whose texts differ in their verdict: its rows are judged by their sets
    mixed, _ = sent_if_small(mixed)
    rows = similar_sets.with_keys(docs.join(mixed, docs["doc_id"] == mixed["_mixed"], "left_semi"), shingle)
    first = found.where("first").select("doc_id", "key").distinct()
    return kept.union(rows.join(first, ["doc_id", "key"], "left_semi").select("row.*"))
