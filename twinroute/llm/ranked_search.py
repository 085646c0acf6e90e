"""Ranked lexical search: dense blocked matrix products of item weights and document impacts.

The items' terms form one vocabulary a block of items, cut into tiles of columns.  For a tile of
documents, their impacts over a column tile (only documents and items with a term in it) are a dense
float64 matrix, as are the items' weights, and one BLAS product adds that tile's part of all
scores.  Weights and impacts are integers and a tile has so few columns that every partial sum
stays below 2^53, so the products are exact in any order of addition; tiles are summed as 64-bit
integers.  A task keeps, for each item, the best ``k`` so far; a score equal to the k-th is kept
until document ids decide, so ties are safe.  Two scans of the documents a block of items: one for
the counts (N, L, document frequencies), one for the scores.  Documents are never shuffled; what
tasks found is cut to k a salt, then to k an item.

Defined results: a null text has no term, as has an empty one; such a document counts nowhere and an
item of that kind has no row; items with one ``item_id`` (null included) are one item, with the terms
of all its rows; a repeated document is a document of its own, and equal scores go by ascending
doc_id, null first; tables without a row give no row; other columns are not read.  Texts of any
length are read whole, a slice at a time.  Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words
from .tables import table, text_and_id

#: Characters of item texts in a block, documents, columns and items of a tile.
BLOCK_CHARS = 1 << 20
DOC_TILE, COLUMN_TILE, ITEM_TILE = 256, 4096, 512
#: Largest impact: 1,000,000,000 tf div (1000 tf + 20 m) with m of 50 or more.
IMPACT_BOUND = 1_000_000
SALTS = 32

_BREAK = np.zeros(256, dtype=bool)
for _a, _b in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _BREAK[_a : _b + 1] = True


def terms(texts: pa.Array) -> words.Words:
    """Terms of every text: runs of ASCII letters, digits and all other characters beyond ASCII; A-Z lower-cased."""
    return words.split(texts, space=_BREAK, fold=words.lower_ascii)


@dataclass
class Items:
    """A block of items: ``columns[first[i]:first[i+1]]`` are the places of item i's terms in ``vocabulary`` (sorted hashes)."""

    ids: list[int | None]
    vocabulary: np.ndarray
    first: np.ndarray
    columns: np.ndarray

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Columns of term hashes; -1 for terms of no item."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)


def block_of(ids: list[int | None], texts: list[str | None]) -> Items:
    names = list(dict.fromkeys(ids))
    number = {x: k for k, x in enumerate(names)}
    found = terms(pa.array(texts, pa.string()))
    owner = np.array([number[x] for x in ids], np.int64)[found.doc_of()]
    vocabulary, column = np.unique(found.hash, return_inverse=True)
    pairs = np.unique(owner * max(len(vocabulary), 1) + column)
    owner, column = np.divmod(pairs, max(len(vocabulary), 1))
    return Items(names, vocabulary, np.searchsorted(owner, np.arange(len(names) + 1)), column)


def item_blocks(items: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[Items]:
    """All items in blocks of about ``block_chars`` characters, one at a time on the driver."""
    plain = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = plain.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = int(size) // block_chars + 1
    for k in range(parts):
        rows = plain.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).collect()
        if rows:
            rows.sort(key=lambda r: (r["item_id"] is not None, r["item_id"] or 0))
            yield block_of([r["item_id"] for r in rows], [r["text"] for r in rows])


@dataclass
class Corpus:
    """Documents with a term (N), all terms (L) and the weight of every column."""

    n_docs: int
    n_terms: int
    weights: np.ndarray


def corpus_of(docs: DataFrame, block: Items) -> Corpus:
    """Counts of all documents; a row a column comes back."""
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        df, n_docs, n_terms = np.zeros(len(known.vocabulary), np.int64), 0, 0
        for batch in batches:
            for part in words.slices(batch, "text"):
                found = terms(part.column("text"))
                n_docs += int(np.count_nonzero(np.diff(found.first)))
                n_terms += len(found.start)
                place = known.places(found.hash)
                hit = place >= 0
                pair = np.unique(found.doc_of()[hit] * max(len(df), 1) + place[hit])
                df += np.bincount(pair % max(len(df), 1), minlength=len(df))[: len(df)]
        at = np.flatnonzero(df)
        rows = np.r_[-2, -1, at], np.r_[n_docs, n_terms, df[at]]
        yield pa.record_batch([pa.array(x.astype(np.int64)) for x in rows], names=["place", "n"])

    found = text_and_id(docs).select("text").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    df, size = np.zeros(len(block.vocabulary), np.int64), {-2: 0, -1: 0}
    for place, n in found:
        if place < 0:
            size[place] = n
        else:
            df[place] = n
    n = size[-2]
    weights = [math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()]
    return Corpus(n, size[-1], np.array(weights, np.int64))


def lengths_cost(n: np.ndarray, corpus: Corpus) -> np.ndarray:
    """m of documents with n terms."""
    if int(n.max(initial=0)) * 50 * corpus.n_docs >= 1 << 62:
        n = n.astype(object)
    return (50 + n * (50 * corpus.n_docs) // max(corpus.n_terms, 1)).astype(np.int64)


class Scorer:
    """Scores of tiles of documents for a block of items."""

    def __init__(self, block: Items, corpus: Corpus, column_tile: int = COLUMN_TILE, item_tile: int = ITEM_TILE):
        # columns of a tile that keep every partial sum below 2^53
        bound = ((1 << 53) - 1) // (IMPACT_BOUND * max(1, int(corpus.weights.max(initial=0))))
        self.block, self.corpus, self.width, self.item_tile = block, corpus, max(1, min(column_tile, bound)), item_tile
        owner = np.repeat(np.arange(len(block.ids)), np.diff(block.first))
        order = np.argsort(block.columns, kind="stable")
        self.by_column, self.owner = block.columns[order], owner[order]
        self._tiles: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def weight_tiles(self, tile: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(items, dense weights) over the columns of a tile, some items at a time; few tiles are kept ready."""
        low = tile * self.width
        a, b = np.searchsorted(self.by_column, [low, low + self.width])
        items = np.unique(self.owner[a:b])
        for k in range(0, len(items), self.item_tile):
            if (ready := self._tiles.get((tile, k))) is None:
                own = items[k : k + self.item_tile]
                place = np.minimum(np.searchsorted(own, self.owner[a:b]), len(own) - 1)
                mine = own[place] == self.owner[a:b]
                dense = np.zeros((len(own), self.width))
                column = self.by_column[a:b][mine]
                dense[place[mine], column - low] = self.corpus.weights[column]
                ready = own, dense
                if len(self._tiles) < 8:
                    self._tiles[tile, k] = ready
            yield ready

    def scores(self, doc: np.ndarray, column: np.ndarray, impact: np.ndarray, n_docs: int) -> np.ndarray:
        """Items by documents, from entries (doc, column, impact) sorted by column."""
        out = np.zeros((len(self.block.ids), n_docs), np.int64)
        tile = column // self.width
        edges = [*np.flatnonzero(np.diff(tile, prepend=-1)).tolist(), len(tile)]
        for a, b in zip(edges, edges[1:], strict=False):
            used, place = np.unique(column[a:b], return_inverse=True)
            docs, at = np.unique(doc[a:b], return_inverse=True)
            dense = np.zeros((len(used), len(docs)))
            dense[place, at] = impact[a:b]
            low = int(tile[a]) * self.width
            for items, weights in self.weight_tiles(int(tile[a])):
                out[np.ix_(items, docs)] += (weights[:, used - low] @ dense).astype(np.int64)
        return out


class Best:
    """The k best (score, then least document) of each item so far."""

    def __init__(self, n_items: int, k: int):
        self.k, self.least = k, np.ones(n_items, np.int64)
        self._found: list[tuple[np.ndarray, ...]] = []
        self._size, self._room = 0, 0

    def add(self, scores: np.ndarray, docs: np.ndarray, known: np.ndarray) -> None:
        item, at = np.nonzero(scores >= self.least[:, None])
        self._found.append((item, scores[item, at], known[at], docs[at]))
        self._size += len(item)
        if self._size > max(1 << 16, 2 * self._room):
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        if not self._found:
            return (np.zeros(0, np.int64),) * 4
        item, score, known, doc = (np.concatenate(x) for x in zip(*self._found, strict=True))
        order = np.lexsort((doc, known, -score, item))
        item, score, known, doc = item[order], score[order], known[order], doc[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        top = rank < self.k
        last = rank == self.k - 1
        self.least[item[last]] = score[last]
        kept = item[top], score[top], known[top], doc[top]
        self._found, self._size, self._room = [kept], int(top.sum()), int(top.sum())
        return kept


def entries(part: pa.RecordBatch, block: Items, corpus: Corpus) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, column, impact) of the terms that items ask for, by document and column."""
    found = terms(part.column("text"))
    place = block.places(found.hash)
    hit = place >= 0
    width = max(len(block.vocabulary), 1)
    pair, tf = np.unique(found.doc_of()[hit] * width + place[hit], return_counts=True)
    doc, column = np.divmod(pair, width)
    m = lengths_cost(np.diff(found.first), corpus)
    return doc, column, (1_000_000_000 * tf) // (1000 * tf + 20 * m[doc])


def search(docs: DataFrame, items: DataFrame, k: int = 50, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's k best documents with a score above 0."""
    spark = docs.sparkSession
    schema = "item_id long, doc_id long, score long"
    out = spark.createDataFrame([], schema)
    plain = text_and_id(docs)
    for block in item_blocks(items, block_chars):
        corpus = corpus_of(docs, block)
        sent = spark.sparkContext.broadcast((block, corpus))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block, corpus = sent.value
            scorer, best = Scorer(block, corpus), Best(len(block.ids), k)
            for batch in batches:
                for part in words.slices(batch, "text"):
                    doc, column, impact = entries(part, block, corpus)
                    ids = part.column("doc_id")
                    known = np.asarray(ids.is_valid().to_numpy(zero_copy_only=False))
                    ids = ids.fill_null(0).to_numpy()
                    present = np.unique(doc)
                    for a in range(0, len(present), DOC_TILE):
                        tile = present[a : a + DOC_TILE]
                        x, y = np.searchsorted(doc, [tile[0], tile[-1] + 1])
                        order = np.argsort(column[x:y], kind="stable")
                        at = np.searchsorted(tile, doc[x:y][order])
                        best.add(scorer.scores(at, column[x:y][order], impact[x:y][order], len(tile)), ids[tile], known[tile])
            item, score, known, doc = best.cut()
            names = pa.array(block.ids, pa.int64()).take(pa.array(item))
            yield pa.record_batch([names, pa.array(doc, pa.int64(), mask=~known.astype(bool)), pa.array(score, pa.int64())], names=["item_id", "doc_id", "score"])

        out = out.unionByName(plain.mapInArrow(run, schema))
    # a salt a part of the tasks first: an item's rows from all tasks never meet in one
    order = (F.desc("score"), F.asc_nulls_first("doc_id"))
    salted = out.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    some = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("item_id", "_salt").orderBy(*order))).where(F.col("_rank") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}') AS t FROM documents),
n AS (SELECT count(*) AS nn, CAST(sum(len(t)) AS BIGINT) AS ll FROM d WHERE len(t) > 0),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS term FROM benchmark),
v AS (SELECT DISTINCT term FROM i),
w AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) JOIN v USING (term) GROUP BY r, term),
f AS (SELECT term, CAST(floor(1000 * ln((2 * max(nn) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM w, n GROUP BY term),
s AS (SELECT item_id, r, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(t) * nn) // ll)))) AS BIGINT) AS score
  FROM i JOIN f USING (term) JOIN w USING (term) JOIN d USING (r), n GROUP BY item_id, r),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank, doc_id, score FROM s JOIN d USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 50
"""
