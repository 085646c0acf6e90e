"""Ranked search against a plain scorer."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from twinroute.llm import ranked_search as rs
from twinroute.llm import tables

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def split(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=50):
    """(item_id, rank, doc_id, score) rows."""
    found = [(d, Counter(split(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in found]
    n, total, df = sum(s > 0 for s in sizes), sum(sizes), Counter(x for _, c in found for x in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(split(t))
    out = []
    for i, terms in asked.items():
        hits = []
        for (d, c), size in zip(found, sizes):
            m = 50 + (50 * size * n) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((10**9 * c[x]) // (1000 * c[x] + 20 * m)) for x in terms if c[x])
            if score > 0:
                hits.append((-score, d is not None, d or 0))
        out += [(i, r, d if known else None, -s) for r, (s, known, d) in enumerate(sorted(hits)[:k], 1)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_terms():
    texts = ["A-b c_d É9é\x00x", None, "", " .,! ", "ÀB C ab"]
    w = rs.terms(pa.array(texts))
    got = [[bytes(w.data[a:b]).decode() for a, b in zip(w.start[x:y], w.end[x:y])] for x, y in zip(w.first, w.first[1:])]
    assert got == [split(t) for t in texts] and got[0] == ["a", "b", "c", "d", "É9é", "x"]


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_tiles_equal_brute_force(data):
    text = st.lists(st.sampled_from("abcdefgh"), max_size=12).map(" ".join)
    docs = [(k % 7, data.draw(text)) for k in range(data.draw(st.integers(1, 12)))]
    items = [(k, data.draw(text)) for k in range(data.draw(st.integers(1, 5)))]
    block = rs.block_of([i for i, _ in items], [t for _, t in items])
    found = [split(t) for _, t in docs]
    df = Counter(x for t in found for x in set(t))
    names = sorted({x for _, t in items for x in split(t)}, key=lambda x: rs.terms(pa.array([x])).hash[0])
    n = sum(map(bool, found))
    corpus = rs.Corpus(n, sum(map(len, found)), np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) for x in names], np.int64))
    part = pa.record_batch({"doc_id": [d for d, _ in docs], "text": [t for _, t in docs]})
    doc, column, impact = rs.entries(part, block, corpus)
    order = np.argsort(column, kind="stable")
    scorer = rs.Scorer(block, corpus, column_tile=data.draw(st.integers(1, 9)), item_tile=data.draw(st.integers(1, 6)))
    scores = scorer.scores(doc[order], column[order], impact[order], len(docs))
    k = data.draw(st.integers(1, 5))
    best, ids, cut = rs.Best(len(block.ids), k), np.array([d for d, _ in docs]), data.draw(st.integers(1, 12))
    for a in range(0, len(docs), cut):
        best.add(scores[:, a : a + cut], ids[a : a + cut], np.ones(len(ids[a : a + cut]), bool))
        if data.draw(st.booleans()):
            best.cut()
    item, score, _, at = best.cut()
    assert sorted((block.ids[i], int(d), int(s)) for i, d, s in zip(item, at, score)) == sorted((i, d, s) for i, _, d, s in brute(docs, items, k))


def test_partial_sums_stay_exact():
    block = rs.block_of([1], [" ".join(map(str, range(50)))])
    assert rs.Scorer(block, rs.Corpus(1, 1, np.full(50, 1 << 40, np.int64))).width == 1
    assert rs.Scorer(block, rs.Corpus(1, 1, np.full(50, 30_000, np.int64))).width * 30_000 * rs.IMPACT_BOUND < 1 << 53
    big = rs.lengths_cost(np.array([10**13, 1]), rs.Corpus(10**12, 10**14, np.zeros(1, np.int64)))
    assert big.tolist() == [50 + 50 * 10**13 * 10**12 // 10**14, 50]


def test_query_equals_brute_force(spark, sf):
    docs, items = tables.table(spark, sf, "documents"), tables.table(spark, sf, "benchmark")
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    got = rs.op11_ranked_search(spark, sf)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and rows_of(got) == want
    # ties, salts and blocks do not depend on how rows are dealt
    assert rows_of(rs.search(docs.repartition(9), items, block_chars=2000)) == want


def test_odd_rows_extra_columns_and_empty_tables(spark):
    from pyspark.sql import functions as F

    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (None, "one Two"), (5, "two " * 30_000 + "one"), *((k, "tie one two") for k in range(200, 90, -1))]
    items = [(7, "one two"), (7, "tie"), (None, "TWO!"), (8, None), (9, "--"), (10, "absent")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for name in ("item_id", "score", "rank", "place", "n", "_salt"):
        d = d.withColumn(name, F.lit("x"))
    i = i.withColumn("doc_id", F.lit("x"))
    got = rows_of(rs.search(d, i))
    assert got == brute(docs, items) and {r[0] for r in got} == {7, None} and [r[2] for r in sorted(got, key=lambda r: r[1]) if r[0] == 7][:5] == [91, 92, 93, 94, 95]
    assert rs.search(d.limit(0), i).count() == 0 and rs.search(d, i.limit(0)).count() == 0
