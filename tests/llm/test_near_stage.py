"""The near-duplicate stage takes its first candidates from op5's fingerprints and verifies them."""

from __future__ import annotations

import random

from twinroute.llm import similar_sets, simhash_dedup

DOC = "doc_id long, text string"


def near_copies():
    """A long text, its copy with one word changed, another text, and a pair of equal fingerprints whose sets are far from similar."""
    rng = random.Random(7)
    words = [rng.choice("abcdefgh") + str(rng.randrange(10**6)) for _ in range(4000)]
    other = [w[::-1] + "x" for w in words[:3000]]
    cycle = "p q r s t " * 400
    rows = [(1, " ".join(words)), (2, " ".join([*words[:2000], "changed", *words[2001:]])), (3, " ".join(other)), (4, cycle), (5, cycle + " ".join(other[:30]))]
    return rows


def test_the_stage_links_by_fingerprint_and_verifies(spark, monkeypatch):
    rows = near_copies()
    prints = {i: simhash_dedup.fingerprint(t.encode(), 5) for i, t in rows}
    assert (prints[1] ^ prints[2]).bit_count() <= 2 and prints[4] == prints[5]
    seen, pairs, grid, verified = [], [], simhash_dedup.links, similar_sets.verified

    def watched(classes):
        found = grid(classes)
        seen.append(({r["fp"] for r in classes.collect()}, found.count()))
        return found

    def counted(asked, sets):
        pairs.append(asked.count())
        return verified(asked, sets)

    monkeypatch.setattr(simhash_dedup, "links", watched)
    monkeypatch.setattr(similar_sets, "verified", counted)
    kept = {r["doc_id"] for r in simhash_dedup.keep_first(spark.createDataFrame(rows, DOC), shingle=5).collect()}
    assert kept == {1, 3, 4, 5}
    # once, over the fingerprints of the texts that may have a partner; the copy is a link, unless one word left the print as it was
    assert len(seen) == 1
    as_long = lambda x: x - (1 << 64) if x >> 63 else x
    assert {as_long(prints[i]) for i in (1, 2)} <= seen[0][0]
    assert seen[0][1] == (prints[1] != prints[2])
    # it joins there, and no round has a pair left for it
    assert pairs[0] >= 1


def test_fingerprints_change_no_group(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cols = ["doc_id", "key", "component_id", "first"]
    plain = similar_sets.groups(docs, 5).select(*cols)
    seeded = similar_sets.groups(docs, 5, simhash_dedup.fingerprint, simhash_dedup.links).select(*cols)
    assert plain.exceptAll(seeded).count() == 0 and seeded.exceptAll(plain).count() == 0
