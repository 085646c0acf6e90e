"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import materialise

#: Edges that a task gathers before it makes stars of them.
BLOCK = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) that connect what the edges connect: every node but the roots, with the least node of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(a):
        # the greater root of an edge goes to the least of its neighbours, and chains of roots are cut short
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the same nodes, at most one a node and partition: those of a partition as stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[np.ndarray] = []
        size = 0
        for batch in batches:
            left.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")]))
            size += batch.num_rows
            if size >= BLOCK:
                left, size = [np.stack(stars(*np.concatenate(left, axis=1)))], 0
        if left:
            a, b = stars(*np.concatenate(left, axis=1))
            yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    return edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is one node of the component.

    Each round maps every node to the least of itself and its neighbours and carries the
    edges over.  Under ids in no particular order (hashes) a round leaves a constant share of
    the nodes, so the rounds follow the logarithm of the largest component.  Each partition first
    makes stars of its own edges: few edges lie in one partition and are done after one round, so the driver
    plans no more rounds than the edges need.  Only links are shuffled; nothing is collected.
    """
    both = contracted(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct())
    both = materialise(both.union(both.select("b", "a")).distinct())
    roots = None
    while not both.isEmpty():
        least = materialise(both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.col("n")).alias("m")))
        if roots is None:
            roots = least.select(F.col("n").alias("node"), F.col("m").alias("root"))
        else:
            moved = roots.join(least, roots["root"] == least["n"], "left")
            roots = materialise(moved.select("node", F.coalesce("m", "root").alias("root")))
        left, right = least.select(F.col("n").alias("a"), F.col("m").alias("ma")), least.select(F.col("n").alias("b"), F.col("m").alias("mb"))
        carried = both.join(left, "a").join(right, "b").select(F.col("ma").alias("a"), F.col("mb").alias("b"))
        both = materialise(carried.where("a != b").distinct())
    if roots is None:
        return both.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
