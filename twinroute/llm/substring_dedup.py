"""Substring dedup over a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words of one document.  Every window is represented in
the index by its *anchor*, the least hash among the ``GRAM``-word grams inside it; equal
windows have equal anchors at equal offsets, so no repeat is missed although only about one
position in eight becomes an entry.  Neighbouring windows that share an anchor form one
entry with a hash of all their words.

A batch adds one immutable run of entries, ordered by anchor.  Merging a batch with the
runs before it on the anchor leaves three kinds of entries: new (kept in the run),
repeats (the same words start earlier: all their windows go), and entries whose anchor also
stands in other words.  The last are verified: their windows are read from the texts, hashed in 128
bits and compared one by one.  ``compact`` merges runs into one.

Copies inside one slice of a task meet there already, so a passage in a large share of all
documents reaches the shuffle once a slice and not once a document.

Defined results: null text has no word; rows that repeat an id count as one document (the words
removed are the union); a null id sorts first; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import materialise, table
from .words import SpanHash, Words, signed, slices, split

WINDOW = 20
GRAM = 6
NO_ID = -(1 << 63)
#: Batches in which a whole table enters the index.
BATCHES = 2

ENTRY = "anchor long, context long, doc_id long, start int, n int, sure boolean"


def minimizers(words: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor, first window, number of windows, document) of every entry of a slice."""
    n = len(words.start)
    empty = np.zeros(0, dtype=np.int64)
    if n < window:
        return empty.view(np.uint64), empty, empty, empty
    doc = words.doc_of()
    at = np.arange(n - gram + 1)
    grams = words.spans().of(at, at + gram)
    starts = np.arange(n - window + 1)
    best, place = grams[: len(starts)].copy(), starts.copy()
    for t in range(1, window - gram + 1):
        other = grams[t : t + len(starts)]
        less = other < best
        np.copyto(best, other, where=less)
        np.copyto(place, starts + t, where=less)
    whole = doc[starts] == doc[starts + window - 1]
    starts, best, place, doc = starts[whole], best[whole], place[whole], doc[starts[whole]]
    if not len(starts):
        return empty.view(np.uint64), empty, empty, empty
    begins = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1) | (doc[1:] != doc[:-1])])
    size = np.diff(np.r_[begins, len(starts)])
    return best[begins], starts[begins], size, doc[begins]


def _first_of(keys: list[np.ndarray], order: list[np.ndarray]) -> np.ndarray:
    """Flags of the rows that are the least of their key by ``order``."""
    sort = np.lexsort([*reversed(order), *reversed(keys)])
    new = np.ones(len(sort), dtype=bool)
    new[1:] = False
    for k in keys:
        s = k[sort]
        new[1:] |= s[1:] != s[:-1]
    out = np.zeros(len(sort), dtype=bool)
    out[sort[new]] = True
    return out


def entries(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Index entries of the documents; ``sure`` ones repeat an earlier entry of the same slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = split(part.column("text"))
                anchor, first, size, doc = minimizers(words, window, gram)
                if not len(anchor):
                    continue
                context = words.spans().of(first, first + size + window - 1)
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)[doc]
                start = first - words.first[doc]
                sure = ~_first_of([anchor, context], [ids, start])
                # sure ones need no comparison: joined to ranges, dealt out evenly
                s = np.flatnonzero(sure)
                joins = np.zeros(len(s), dtype=bool)
                joins[1:] = (s[1:] == s[:-1] + 1) & (doc[s[1:]] == doc[s[:-1]]) & (start[s[1:]] == start[s[:-1]] + size[s[:-1]])
                heads = np.flatnonzero(~joins)
                total = np.add.reduceat(size[s], heads) if len(s) else size[s]
                head, rest = s[heads], np.flatnonzero(~sure)
                columns = [
                    np.r_[signed(anchor)[rest], ids[head] * 0x9E3779B1 + start[head]],
                    np.r_[signed(context)[rest], np.zeros(len(head), dtype=np.int64)],
                    np.r_[ids[rest], ids[head]],
                    np.r_[start[rest], start[head]].astype(np.int32),
                    np.r_[size[rest], total].astype(np.int32),
                    np.r_[sure[rest], sure[head]],
                ]
                yield pa.record_batch([*map(pa.array, columns)], names=["anchor", "context", "doc_id", "start", "n", "sure"])

    return docs.mapInArrow(run, ENTRY)


def merge(batch: DataFrame, history: list[DataFrame]) -> DataFrame:
    """Entries of the batch, and those of the runs that it meets, with their verdict:

    ``new``; ``repeat``: an earlier entry has the same words; ``verify``: the anchor also stands in other words.
    """
    found = batch.withColumn("age", F.lit(1))
    for run in history:
        found = found.unionByName(run.select("anchor", "context", "doc_id", "start", "n", F.lit(False).alias("sure"), F.lit(0).alias("age")))
    dealt = found.repartition("anchor")
    same = Window.partitionBy("anchor", "sure", "context")
    anchor = Window.partitionBy("anchor", "sure")
    place = F.struct("age", "doc_id", "start")
    judged = dealt.withColumn("first", F.min(place).over(same) == place)
    judged = judged.withColumn("many", F.min("context").over(anchor) != F.max("context").over(anchor))
    judged = judged.withColumn("met", F.max("age").over(anchor) == 1)
    verdict = F.when(~F.col("first") | F.col("sure"), "repeat").when(F.col("many"), "verify").otherwise("new")
    return judged.where("met").select("anchor", "context", "doc_id", "start", "n", "age", verdict.alias("verdict")).where("age = 1 OR verdict = 'verify'")


def _with_ranges(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """docs with their ranges (arrays start, n; null if none) by doc_id; a document has no more ranges than words."""
    held = ranges.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "n"))).alias("r"))
    return docs.join(held.select(F.col("doc_id").alias("_id"), F.col("r.start").alias("_start"), F.col("r.n").alias("_n")), docs["doc_id"] == F.col("_id"), "left")


def windows(texts: DataFrame, asked: DataFrame, window: int = WINDOW) -> DataFrame:
    """(h1, h2, doc_id, start, sure) of every window that ``asked`` (doc_id, start, n) names."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                lists, n = part.column("_start"), part.column("_n")
                words = split(part.column("text"))
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                per = np.diff(lists.offsets.to_numpy())
                doc = np.repeat(np.arange(len(ids)), per)
                first = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                size = n.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                at = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                doc = np.repeat(doc, size)
                place = words.first[doc] + at
                fits = place + window <= words.first[doc + 1]
                at, doc, place = at[fits], doc[fits], place[fits]
                if not len(at):
                    continue
                h1 = words.spans().of(place, place + window)
                h2 = SpanHash(words.hash, 0xC2B2AE3D27D4EB4F | 1).of(place, place + window)
                sure = ~_first_of([h1, h2], [ids[doc], at])
                h1[sure] = doc[sure].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + at[sure].astype(np.uint64)
                yield pa.record_batch([*map(pa.array, (signed(h1), signed(h2), ids[doc], at.astype(np.int32), sure))], names=["h1", "h2", "doc_id", "start", "sure"])

    joined = _with_ranges(texts, asked.select("doc_id", "start", "n")).where("_id IS NOT NULL").select("doc_id", "text", "_start", "_n")
    return joined.mapInArrow(run, "h1 long, h2 long, doc_id long, start int, sure boolean")


def verified(texts: DataFrame, asked: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, n=1): windows of the batch whose words start earlier."""
    found = windows(texts, asked, window)
    place = F.struct("doc_id", "start")
    first = F.min(place).over(Window.partitionBy("h1", "h2", "sure")) == place
    return found.withColumn("first", first).where("sure OR NOT first").select("doc_id", "start", F.lit(1).alias("n"))


def plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


class FingerprintIndex:
    """Runs of entries for incremental dedup: batches come in order of doc_id."""

    def __init__(self, window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        self.runs: list[DataFrame] = []

    def add(self, batch: DataFrame, texts: DataFrame | None = None, since: int | None = None) -> DataFrame:
        """(doc_id, start, n) ranges of repeated windows in the batch; its entries become a run.

        texts: documents (doc_id, text) that hold the batch and every earlier one, for verification; only those whose anchors
        met are read.  since: the batch's least id, where known.
        """
        found = materialise(merge(entries(batch, self.window, self.gram), self.runs), ["verdict"])
        self.runs.append(found.where("age = 1 AND verdict <> 'repeat'"))
        repeats = found.where("verdict = 'repeat'").select("doc_id", "start", "n")
        checked = verified(batch if texts is None else texts, found.where("verdict = 'verify'"), self.window)
        if since is not None:
            checked = checked.where(F.col("doc_id") >= since)
        elif len(self.runs) > 1:
            checked = checked.join(batch.select("doc_id").distinct(), "doc_id", "left_semi")
        return repeats.unionByName(checked)

    def compact(self) -> None:
        """All runs as one, ordered by anchor."""
        merged = self.runs[0]
        for run in self.runs[1:]:
            merged = merged.unionByName(run)
        place = F.struct("doc_id", "start", "n")
        least = merged.groupBy("anchor", "context").agg(F.min(place).alias("p"), F.min("age").alias("age"), F.min("verdict").alias("verdict"))
        ordered = least.select("anchor", "context", "p.*", "age", "verdict").repartition("anchor").sortWithinPartitions("anchor", "context")
        self.runs = [materialise(ordered)]


def cut(docs: DataFrame, ranges: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the words covered by the ranges' windows taken out of the text, and n_words and n_removed.

    Kept words are joined by one space.
    """
    names = [c for c in docs.columns]
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    text_at = names.index("text")

    def run(batches):
        for batch in batches:
            columns = [batch.column(c) for c in names]
            starts, sizes = batch.column("_start").to_pylist(), batch.column("_n").to_pylist()
            texts, n_words, n_removed = [], [], []
            for text, s, n in zip(columns[text_at].cast(pa.binary()).to_pylist(), starts, sizes, strict=True):
                words = (text or b"").split()
                kept = words
                if s:
                    steps = np.zeros(len(words) + 1, dtype=np.int64)
                    a = np.minimum(np.array(s), len(words))
                    np.add.at(steps, a, 1)
                    np.add.at(steps, np.minimum(np.array(s) + np.array(n) + window - 1, len(words)), -1)
                    keep = np.cumsum(steps)[: len(words)] == 0
                    kept = [words[i] for i in np.flatnonzero(keep).tolist()]
                texts.append(b" ".join(kept).decode())
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
            columns[text_at] = pa.array(texts, pa.string())
            yield pa.record_batch([*columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=[*names, "n_words", "n_removed"])

    return _with_ranges(docs, ranges).select(*(docs[c] for c in names), "_start", "_n").mapInArrow(run, schema)


def repeats(docs: DataFrame, texts: DataFrame, window: int, gram: int, batches: int = BATCHES) -> DataFrame:
    """(doc_id, start, n) ranges of all repeated windows: the documents enter the index batch by batch, in order of doc_id.

    texts: the same documents (doc_id, text), dealt by doc_id.
    """
    plain_docs = plain(docs)
    edges = plain_docs.where(F.col("doc_id") != NO_ID).approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01)
    edges = [NO_ID, *sorted({int(x) for x in edges})]
    index, found = FingerprintIndex(window, gram), None
    for lo, hi in zip(edges, [*edges[1:], None], strict=True):
        batch = plain_docs.where(F.col("doc_id") >= lo if hi is None else (F.col("doc_id") >= lo) & (F.col("doc_id") < hi))
        ranges = index.add(batch, texts, lo)
        found = ranges if found is None else found.unionByName(ranges)
    return found


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """doc_id, text without repeated windows, n_words and n_removed of every document."""
    texts = plain(docs).repartition("doc_id")
    return cut(texts, repeats(docs, texts, window, gram, batches), window).withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def rewrite(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs with repeated windows taken out of the texts, same columns; texts left empty by that go.

    ``n_chars``, where there is one, follows the text.
    """
    others = [c for c in docs.columns if c != "text"]
    # the other columns travel as one, so no name of theirs can clash
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in others)).alias("others")).repartition("doc_id")
    done = cut(texts, repeats(docs, texts, window, gram), window).where("n_removed = 0 OR n_words > n_removed")
    changed = {"text": F.col("text"), "n_chars": F.length("text")}
    restored = lambda c: changed.get(c, F.col("others").getField(c)) if c != "text" else changed[c]
    return done.select(*(restored(c).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))
