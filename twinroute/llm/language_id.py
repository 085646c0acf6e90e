"""Language ID by prediction by partial matching.

For each language a byte context tree of order 3 holds how often each byte followed each
context.  A text's code length under a tree is exact: every byte costs the logarithm of its
probability in the longest context seen, with escape probabilities (method C: distinct over
total plus distinct) down to shorter contexts and at last 1/256.  The statistics are frozen after
training; the language of least code length wins (ties: the lesser name).

Training counts 4-byte grams of all labelled texts inside the tasks and sums them by
(language, gram); shorter contexts are their margins.  A tree keeps all grams of its language: distinct runs of four
bytes, of which text has far fewer than words.  ``max_grams`` (off) keeps only the most frequent ones.

Defined results: a text that is null or has no letter is ``und`` with score 0, and so is every
text when nothing was learned; null ids are never held out and never learned from; repeated rows are
separate; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import table
from .words import buffers, slices

ORDER = 3
#: Distinct grams with code lengths that a task keeps between slices.
CACHE = 1 << 20


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(gram of every byte, offsets by text): the byte and the three before it, zeros before a text's start."""
    data, offsets = buffers(pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")))
    out = data.astype(np.uint32)
    begin = np.zeros(len(data), dtype=np.int64)
    filled = offsets[:-1][np.diff(offsets) > 0]
    begin[filled[1:]] = np.diff(filled)
    place = np.arange(len(data)) - np.cumsum(begin)
    for back in range(1, ORDER + 1):
        older = np.zeros(len(data), dtype=np.uint32)
        older[back:] = data[:-back] if back else data
        older[place < back] = 0
        out |= older << np.uint32(8 * back)
    return out, offsets


def count(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n) over all labelled texts; counted in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def flush():
            for lang, (g, n) in held.items():
                yield pa.record_batch([pa.array([lang] * len(g)), pa.array(g.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for part in slices(batch, "text"):
                langs = part.column("lang")
                for lang in pc.unique(langs).to_pylist():
                    g, n = np.unique(grams(part.column("text").filter(pc.equal(langs, lang)))[0], return_counts=True)
                    if lang in held:
                        g, n = np.r_[held[lang][0], g], np.r_[held[lang][1], n]
                        g, at = np.unique(g, return_inverse=True)
                        n = np.bincount(at, weights=n, minlength=len(g)).astype(np.int64)
                    held[lang] = g, n
                if sum(len(g) for g, _ in held.values()) > CACHE:
                    yield from flush()
        yield from flush()

    seen = labelled.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return seen.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Tree:
    """A language's context tree as sorted arrays for each order."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        self.levels = []
        for order in range(ORDER + 1):
            short, at = np.unique(gram & np.uint32((1 << (8 * (order + 1))) - 1) if order < ORDER else gram, return_inverse=True)
            c = np.bincount(at, weights=n, minlength=len(short))
            context, at = np.unique(short >> np.uint32(8), return_inverse=True)
            self.levels.append((short, c, context, np.bincount(at, weights=c), np.bincount(at).astype(float)))

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each gram after the bytes before it."""
        p = np.full(len(gram), 1 / 256)
        for order, (short, c, context, total, kinds) in enumerate(self.levels):
            own = gram & np.uint32((1 << (8 * (order + 1))) - 1) if order < ORDER else gram
            k = np.minimum(np.searchsorted(context, own >> np.uint32(8)), len(context) - 1)
            known = context[k] == own >> np.uint32(8)
            i = np.minimum(np.searchsorted(short, own), len(short) - 1)
            seen = short[i] == own
            whole = total[k] + kinds[k]
            p = np.where(known, np.where(seen, c[i] / whole, kinds[k] / whole * p), p)
        return -np.log2(p)


class Model:
    """Trees of all languages, with the code lengths of the grams met so far."""

    def __init__(self, trees: dict[str, Tree]):
        self.langs = sorted(trees)
        self.trees = [trees[x] for x in self.langs]
        self._grams = np.zeros(0, dtype=np.uint32)
        self._bits = np.zeros((0, len(trees)))

    def code_lengths(self, texts: pa.Array) -> np.ndarray:
        """Bits of every text under every language: (texts, languages)."""
        gram, offsets = grams(texts)
        if not len(gram):
            return np.zeros((len(texts), len(self.langs)))
        own, at = np.unique(gram, return_inverse=True)
        new = np.setdiff1d(own, self._grams, assume_unique=True)
        if len(new):
            keep = self._grams if len(self._grams) < CACHE else self._grams[:0]
            both = np.r_[keep, new] if len(keep) == len(self._grams) else own
            fresh = new if len(keep) == len(self._grams) else own
            bits = np.stack([t.bits(fresh) for t in self.trees], axis=1)
            bits = np.r_[self._bits, bits] if len(keep) == len(self._grams) else bits
            order = np.argsort(both)
            self._grams, self._bits = both[order], bits[order]
        of_own = self._bits[np.searchsorted(self._grams, own)]
        out = np.zeros((len(texts), len(self.langs)))
        filled = np.flatnonzero(np.diff(offsets) > 0)
        for k in range(len(self.langs)):
            out[filled, k] = np.add.reduceat(of_own[at, k], offsets[:-1][filled])
        return out


def most_frequent(counts: DataFrame, limit: int) -> DataFrame:
    """About the ``limit`` most frequent grams of each language, at most that many but for a hash's chance.

    The count where a language reaches the limit is found on its histogram of counts, so no task orders the
    grams themselves; of the grams with just that count a hash picks the share that fits.
    """
    levels = counts.groupBy("lang", "n").agg(F.count("*").alias("k"))
    so_far = F.sum("k").over(Window.partitionBy("lang").orderBy(F.desc("n")))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(limit) - (so_far - F.col("k"))) / F.col("k")))
    taken = levels.withColumn("share", share).where("share > 0").groupBy("lang").agg(F.min("n").alias("least"), F.min_by("share", "n").alias("share"))
    pick = F.pmod(F.xxhash64("gram"), F.lit(1 << 20)) < F.col("share") * (1 << 20)
    # a row per language
    joined = counts.join(F.broadcast(taken), "lang")
    return joined.where((F.col("n") > F.col("least")) | ((F.col("n") == F.col("least")) & pick)).select("lang", "gram", "n")


def train(labelled: DataFrame, max_grams: int | None = None) -> Model:
    """Trees from the texts and their non-null lang."""
    counts = count(labelled.where("lang IS NOT NULL AND text IS NOT NULL"))
    kept = (counts if max_grams is None else most_frequent(counts, max_grams)).toPandas()
    return Model({lang: Tree(g["gram"].to_numpy().astype(np.uint32), g["n"].to_numpy().astype(float)) for lang, g in kept.groupby("lang")})


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (the winner's share of likelihood) of every row, and the columns given besides text."""
    sent = docs.sparkSession.sparkContext.broadcast(model.trees), tuple(model.langs)
    names = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]
    letter = re.compile(r"[^\W\d_]")

    def run(batches):
        known = Model(dict(zip(sent[1], sent[0].value, strict=True)))
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                some = np.array([bool(t and letter.search(t)) for t in texts], dtype=bool)
                pred, score = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
                if known.langs:
                    bits = known.code_lengths(part.column("text"))
                    best = bits.argmin(axis=1)
                    share = 1 / np.exp2(np.maximum(bits.min(axis=1)[:, None] - bits, -1000)).sum(axis=1)
                    pred[some] = np.array(known.langs, dtype=object)[best[some]]
                    score[some] = share[some]
                yield pa.record_batch([*(part.column(c) for c in names), pa.array(pred, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(names).schema)
    return docs.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's text modulo parts."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", remainder(F.col("doc_id"), 4).alias("part"))
    model = train(docs.where("part <> 2"))
    asked = docs.select("doc_id", F.coalesce(F.col("part") == 2, F.lit(False)).alias("held_out"), "text")
    return predict(asked, model)
