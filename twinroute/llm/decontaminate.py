"""Benchmark decontamination by greedy string tiling.

Shared ``MIN_MATCH``-token seeds join documents with test items.  For each pair the longest
match of unmarked tokens is tiled first, again and again, until none of ``MIN_MATCH``
tokens is left; running (Karp-Rabin) hashes find the matches, so a passage that was cut
up and reordered is covered tile by tile.  A pair counts when the tiles cover ``COVERAGE`` of
the test item.

A pair is looked at only where it can count.  Seeds that more than ``COMMON`` places of the
benchmark hold make no candidate as long as all such places of an item together cover less than
``COVERAGE`` of it: a pair that counts then meets another seed of the item as well.  Candidates
are compared in steps of bounded size, and those whose hits form one match, which is the usual case
of a common line, need no search for the longest.

The benchmark goes to the tasks as seed tables in blocks of at most ``BLOCK_TOKENS`` tokens,
each block scanning the documents once; documents are never shuffled.

Tokens are lower-cased runs of ASCII letters and digits and of any other non-ASCII
characters.  Defined results: null text has no token; an item without tokens matches
nothing; an item shorter than ``MIN_MATCH`` matches only whole; repeated ids are separate
rows; null ids are returned as null; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table, text_and_id
from .words import Words, slices, split

MIN_MATCH = 5
COVERAGE = 0.5
BLOCK_TOKENS = 1 << 20
COMMON = 8  #: places of a seed from which it is common
STEP = 1 << 19  #: entries compared at a time (one pair at least)

_GAP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def tokens(texts: pa.Array) -> Words:
    return split(pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")), space=_GAP)


@dataclass
class Grams:
    """Seeds of one length.  Item k has its seeds, by place, in ``own[first[k]:first[k + 1]]`` as numbers into
    the sorted ``known``; seed g makes the items ``items[at[g]:at[g + 1]]`` candidates."""

    known: np.ndarray
    own: np.ndarray
    first: np.ndarray
    items: np.ndarray
    at: np.ndarray


@dataclass
class Seeds:
    """Seed table of a benchmark block, by seed length, for coverages of ``coverage`` or more."""

    ids: list
    sizes: np.ndarray
    coverage: float
    grams: dict[int, Grams]


def spare(common: np.ndarray, size: int, total: int, coverage: float) -> np.ndarray:
    """Of the common places of an item of ``total`` tokens, as many as cover less than ``coverage`` of it together."""
    covered, out = np.zeros(total, dtype=bool), []
    for place in common:
        more = covered.sum() + size - covered[place : place + size].sum()
        if more < coverage * total:
            covered[place : place + size] = True
            out.append(place)
    return np.array(out, dtype=np.int64)


def seeds(ids: list, texts: list, min_match: int = MIN_MATCH, coverage: float = 0.0) -> Seeds:
    words = tokens(pa.array(texts, pa.string()))
    sizes = np.diff(words.first)
    spans = words.spans()
    lengths = np.minimum(sizes, min_match)
    grams = {}
    for size in sorted(set(lengths.tolist()) - {0}):
        per = np.where(lengths == size, sizes - size + 1, 0)
        first = np.r_[0, np.cumsum(per)]
        item, place = spread(per)
        start = words.first[item] + place
        known, own, times = np.unique(spans.of(start, start + size), return_inverse=True, return_counts=True)
        makes = np.ones(len(own), dtype=bool)
        common = times[own] > COMMON
        for k in np.unique(item[common]):
            here = slice(first[k], first[k + 1])
            rarest = np.flatnonzero(common[here])
            rarest = rarest[np.argsort(-times[own[here]][rarest], kind="stable")]
            makes[first[k] + spare(rarest, size, int(sizes[k]), coverage)] = False
        pairs = np.unique(own[makes] * len(ids) + item[makes])
        grams[size] = Grams(known, own, first, pairs % len(ids), np.searchsorted(pairs // len(ids), np.arange(len(known) + 1)))
    return Seeds(ids, sizes, coverage, grams)


def spread(per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, number in the owner) of ``per[k]`` entries for each owner k."""
    owner = np.repeat(np.arange(len(per)), per)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)


def steps(per: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of owners with at most ``most`` entries each, one owner at least."""
    total, at = np.cumsum(per), 0
    while at < len(per):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        yield slice(at, stop)
        at = stop


def tile(i: np.ndarray, j: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (item place, document place, tokens) from seed hits of ``size`` tokens.

    Hits on one diagonal in a row are one match.  The longest match goes first (ties: the first in
    the item, then in the document); hits that touch its tokens are gone after.
    """
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    tiles = []
    while len(i):
        breaks = np.r_[True, (i[1:] != i[:-1] + 1) | (j[1:] - i[1:] != j[:-1] - i[:-1])]
        heads = np.flatnonzero(breaks)
        runs = np.diff(np.r_[heads, len(i)])
        best = np.lexsort((j[heads], i[heads], -runs))[0]
        a, b, n = int(i[heads[best]]), int(j[heads[best]]), int(runs[best]) + size - 1
        tiles.append((a, b, n))
        free = ((i + size <= a) | (i >= a + n)) & ((j + size <= b) | (j >= b + n))
        i, j = i[free], j[free]
    return tiles


def matches(part: pa.RecordBatch, known: Seeds, coverage: float, one: bool = False) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, number of tiles, tokens tiled) of every pair in a slice that reaches the coverage, at least that of ``known``.

    ``one``: a row that was found once need not be compared again.
    """
    words = tokens(part.column("text"))
    doc = words.doc_of()
    found = np.zeros(part.num_rows, dtype=bool)
    for size, grams in known.grams.items():
        at = np.arange(max(len(words.start) - size + 1, 0))
        at = at[doc[at] == doc[at + size - 1]]
        gram = words.spans().of(at, at + size)
        seed = np.minimum(np.searchsorted(grams.known, gram), len(grams.known) - 1)
        hit = grams.known[seed] == gram
        at, seed = at[hit], seed[hit]
        # hits by (document, seed), each key with its places in order
        key = doc[at] * len(grams.known) + seed
        order = np.argsort(key, kind="stable")
        places = at[order]
        key, begin, times = np.unique(key[order], return_index=True, return_counts=True)
        row, seed = key // len(grams.known), key % len(grams.known)
        makes = grams.at[seed + 1] - grams.at[seed]
        heads = np.flatnonzero(np.diff(row, prepend=-1))
        bounds = np.r_[heads, len(row)]
        for docs in steps(np.add.reduceat(makes, heads) if len(heads) else makes, STEP):
            seen = slice(bounds[docs.start], bounds[docs.stop])
            owner, number = spread(makes[seen])
            pair = np.unique(row[seen][owner] * len(known.ids) + grams.items[grams.at[seed[seen]][owner] + number])
            r, k = pair // len(known.ids), pair % len(known.ids)
            if one:  # the first pair of every row first
                turn = np.argsort(np.arange(len(r)) - np.searchsorted(r, r), kind="stable")
                r, k = r[turn], k[turn]
            for some in steps(grams.first[k + 1] - grams.first[k], STEP):
                rs, ks = r[some], k[some]
                if one:
                    rs, ks = rs[~found[rs]], ks[~found[rs]]
                hits = meet(rs, ks, grams, key, begin, times, places)
                for p, tiles, tiled in covered(*hits, size, known.sizes[ks], coverage):
                    if not (one and found[rs[p]]):
                        found[rs[p]] = True
                        yield int(rs[p]), int(ks[p]), tiles, tiled


def meet(row: np.ndarray, item: np.ndarray, grams: Grams, key: np.ndarray, begin: np.ndarray, times: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, item place, document place) of all hits of the pairs, in that order."""
    pair, i = spread(grams.first[item + 1] - grams.first[item])
    asked = row[pair] * len(grams.known) + grams.own[grams.first[item][pair] + i]
    at = np.minimum(np.searchsorted(key, asked), len(key) - 1)
    hit = key[at] == asked
    pair, i, at = pair[hit], i[hit], at[hit]
    entry, number = spread(times[at])
    return pair[entry], i[entry], places[begin[at][entry] + number]


def covered(pair: np.ndarray, i: np.ndarray, j: np.ndarray, size: int, total: np.ndarray, coverage: float) -> Iterator[tuple[int, int, int]]:
    """(pair, tiles, tokens tiled) of the pairs that reach the coverage; hits come by (pair, i, j)."""
    if not len(pair):
        return
    new = np.r_[True, (pair[1:] != pair[:-1]) | (i[1:] != i[:-1])]
    p, place = pair[new], i[new]
    last = np.r_[p[1:] != p[:-1], True]
    most = np.bincount(p, np.where(last, size, np.minimum(np.r_[np.diff(place), size], size)), len(total))  # tiles cover no more
    able = (most >= coverage * total)[pair]
    pair, i, j = pair[able], i[able], j[able]
    if not len(pair):
        return
    order = np.lexsort((i, j - i, pair))
    pair, i, j = pair[order], i[order], j[order]
    same = pair[1:] == pair[:-1]
    runs = np.bincount(pair[1:][same & ((i[1:] != i[:-1] + 1) | (j[1:] - i[1:] != j[:-1] - i[:-1]))], minlength=len(total)) + 1
    heads = np.flatnonzero(np.r_[True, ~same])
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(pair)], strict=True):
        q = int(pair[a])
        if runs[q] == 1:
            tiles, tiled = 1, b - a + size - 1
        else:
            found = tile(i[a:b], j[a:b], size)
            tiles, tiled = len(found), sum(t[2] for t in found)
        if tiled >= coverage * total[q]:
            yield q, tiles, tiled


def blocks(benchmark: DataFrame, coverage: float = COVERAGE, min_match: int = MIN_MATCH, block_tokens: int = BLOCK_TOKENS) -> Iterator[Seeds]:
    """Seed tables of the whole benchmark, each over at most about ``block_tokens`` tokens."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = int(size) // (4 * block_tokens) + 1
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()
        if rows:
            rows.sort(key=lambda r: (r["item_id"] is None, r["item_id"], r["text"]))
            yield seeds([r["item_id"] for r in rows], [r["text"] for r in rows], min_match, coverage)


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, min_match: int = MIN_MATCH) -> DataFrame:
    """doc_id, item_id, n_tiles, n_tiled, n_tokens and coverage of every contaminated pair."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, n_tiles long, n_tiled long, n_tokens long, coverage double"
    out = spark.createDataFrame([], schema)
    plain = text_and_id(docs)
    for block in blocks(benchmark, coverage, min_match):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            known = sent.value
            for batch in batches:
                for part in slices(batch, "text"):
                    ids = part.column("doc_id").to_pylist()
                    rows = [(ids[r], known.ids[k], t, n, int(known.sizes[k]), n / int(known.sizes[k])) for r, k, t, n in matches(part, known, coverage)]
                    if rows:
                        kinds = [pa.int64()] * 5 + [pa.float64()]
                        yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "n_tiles", "n_tiled", "n_tokens", "coverage"])

        out = out.unionByName(plain.mapInArrow(run, schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, min_match: int = MIN_MATCH) -> DataFrame:
    """The documents that leak no test item, all columns unchanged.  Rows are judged where they are."""
    spark = docs.sparkSession
    names = docs.columns
    for block in blocks(benchmark, coverage, min_match):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            for batch in batches:
                for part in slices(batch, "text"):
                    keep = np.ones(part.num_rows, dtype=bool)
                    keep[[row for row, *_ in matches(part, sent.value, coverage, one=True)]] = False
                    yield part.filter(pa.array(keep)).select(names)

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
