"""Components: stars of a partition's own edges first, so the driver plans few rounds."""

from __future__ import annotations

import random

import numpy as np

from twinroute.llm import components


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {frozenset(y for y in root if find(y) == find(x)) for x in root}


def found(frame):
    groups = {}
    for r in frame.collect():
        groups.setdefault(r["root"], {r["root"]}).add(r["node"])
    return {frozenset(g) for g in groups.values()}


def test_stars_connect_what_the_edges_connect():
    rng = random.Random(5)
    for n, m in ((10, 5), (200, 150), (50, 400)):
        edges = [(rng.randrange(-n, n), rng.randrange(-n, n)) for _ in range(m)]
        edges = [(a, b) for a, b in edges if a != b]
        a, b = components.stars(*np.array(edges, dtype=np.int64).T)
        assert len(a) == len(set(a.tolist())) and not set(a.tolist()) & set(b.tolist())
        assert brute(zip(a.tolist(), b.tolist(), strict=True)) == brute(edges)


def test_few_edges_take_one_round(spark, monkeypatch):
    rng = random.Random(6)
    ids = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(400)]
    chain = [*zip(ids[:300], ids[1:300], strict=False), *zip(ids[300:350], ids[350:], strict=True), (ids[0], ids[0])]
    calls, write = [], components.materialise
    monkeypatch.setattr(components, "materialise", lambda df: (calls.append(1), write(df))[1])
    assert found(components.components(spark.createDataFrame(chain, "a long, b long"))) == brute(chain)
    # the edges, the least neighbours and the edges that are left; formerly three tables a round
    assert len(calls) <= 3


def test_edges_in_blocks_and_partitions(spark, monkeypatch):
    monkeypatch.setattr(components, "BLOCK", 4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = random.Random(8)
        edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(110)]
        edges = [(a, b) for a, b in edges if a != b]
        assert found(components.components(spark.createDataFrame(edges, "a long, b long"))) == brute(edges)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
