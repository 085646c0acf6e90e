"""All links between texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

No link is lost.  A set of n shingles that is similar to another shares at least ``ceil(0.8 n)`` of them, so a
set with more shingles of its own than ``n - ceil(0.8 n)`` has no partner: that is most texts, and they
are found by one aggregation over a part of the hash range (``SHARE``; a set's own shingles in that part are
at most all of its own ones, so nobody goes wrongly).  Among the sets that are left, the shingles of
every set stand in one order, the rarest first, and two similar sets share one of their first ``n - ceil(0.8 n) + 1``
shingles in it (prefix filter), so only these are entered, and of these only the ones that another set holds.

The first candidates may come by fingerprints (``near``): sets whose fingerprints are linked are verified and join before any
shingle is held against another, so the rounds only look for what fingerprints have not found.

Candidates are taken in rounds, so that large groups of near copies need about as many comparisons as they have
members: in a round every set is held against one set of another group, one that heads most of its shingles (a member
of the largest group that holds the shingle), and what is verified joins the groups; the later rounds take ``HEADS`` heads of a shingle, and those of all its shingles.  After ``ROUNDS`` come all pairs that are not connected yet.  A
pair goes on only if its sizes and the places of its shingles admit the similarity, and is verified on the whole sets.

Words are those of ``split`` in lower case (ASCII), a text with fewer words than a shingle is one shingle, and
null text counts as empty: its set is empty and equals other empty sets.  Shingles and sets are compared by 64-bit hashes.
Very long texts are sets like any other; repeated rows have equal sets; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .tables import materialise, scratch, sent_if_small, text_and_id
from .words import lower_ascii, mix, signed, slices, split

#: The least similarity, as a fraction.
OVER, UNDER = 4, 5
#: The part of the hash range in which a set's own shingles are counted: over 1 - OVER / UNDER.
SHARE = 0.4
ROUNDS = 4
#: Heads of a shingle in the later half of the rounds.
HEADS = 32


def shingle_sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """The distinct shingle hashes of every text, sorted."""
    words = split(texts, fold=lower_ascii)
    spans, found = words.spans(), []
    for a, b in zip(words.first, words.first[1:], strict=False):
        start = np.arange(a, max(b - shingle + 1, min(a + 1, b)))
        found.append(np.unique(spans.of(start, np.minimum(start + shingle, b))))
    return found


def set_key(items: np.ndarray) -> int:
    """Hash of a sorted set."""
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(items.astype("<u8").tobytes())).astype(np.int64))


def shingled(docs: DataFrame, shingle: int, share: float = 1.0, fingerprint: Callable[[bytes, int], int] | None = None) -> DataFrame:
    """doc_id, key, n and items (those in the given part of the hash range) of every row; with ``fingerprint`` also fp, that of the text."""
    top = np.uint64(min(int(share * 2**64), 2**64 - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), shingle)
                some = [signed(x[mix(x) <= top]) for x in sets]
                found = {"doc_id": part.column("doc_id"), "key": pa.array([set_key(x) for x in sets], pa.int64()), "n": pa.array([len(x) for x in sets], pa.int32()), "items": pa.array(some, pa.list_(pa.int64()))}
                if fingerprint is not None:
                    prints = (fingerprint(t.as_py() or b"", shingle) for t in part.column("text").cast(pa.binary()))
                    found["fp"] = pa.array(np.array([*prints], dtype=np.uint64).view(np.int64))
                yield pa.record_batch(found)

    return docs.mapInArrow(run, "doc_id long, key long, n int, items array<long>" + (", fp long" if fingerprint is not None else ""))


def prefix(n: Column) -> Column:
    """How many of the first shingles of a set are entered."""
    return n - F.ceil(n * OVER / UNDER) + 1


def sharing(marked: DataFrame) -> DataFrame:
    """key, n and least (the smallest id, null if one is null) of the sets that may have a partner."""
    held = marked.select("key", F.explode("items").alias("item"))
    own = held.groupBy("item").agg(F.min("key").alias("key"), F.max("key").alias("last")).where("key = last").groupBy("key").agg(F.count("*").alias("own"))
    # sets of fewer shingles are similar to equal ones only
    classes = marked.where(F.col("n") + 1 >= UNDER).groupBy("key").agg(F.first("n").alias("n"), F.min(F.struct("doc_id"))["doc_id"].alias("least"))
    return classes.join(own, "key", "left").where(F.coalesce("own", F.lit(0)) < prefix(F.col("n"))).select("key", "n", "least")


def entered(sets: DataFrame) -> DataFrame:
    """(item, key, n, pos): the shingles that a set enters and another set holds; pos is the place in the set's order."""
    items = sets.select("key", "n", F.explode("items").alias("item"))
    known = items.join(items.groupBy("item").agg(F.count("*").alias("df")).where("df > 1"), "item")
    of_key = Window.partitionBy("key")
    # a set's own shingles come first
    pos = F.col("n") - F.count("*").over(of_key) + F.row_number().over(of_key.orderBy("df", "item")) - 1
    return known.withColumn("pos", pos.cast("int")).where(F.col("pos") < prefix(F.col("n"))).select("item", "key", "n", "pos")


def may(n_a: Column, n_b: Column, pos_a: Column, pos_b: Column) -> Column:
    """Whether sizes and places of a shared shingle, if it is the first one, admit the similarity."""
    least = F.least(n_a - pos_a, n_b - pos_b)
    return (UNDER * F.least(n_a, n_b) >= OVER * F.greatest(n_a, n_b)) & (UNDER * least >= OVER * (n_a + n_b - least))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of keys whose sets are similar.  Only sets that a pair names are shuffled, where the names can be sent."""
    pairs = materialise(pairs)
    if pairs.isEmpty():
        return pairs
    # each side's keys are few, however many pairs a head has
    side = lambda c: pairs.select(F.col(c).alias("key")).distinct()
    named, small = sent_if_small(side("a").union(side("b")).distinct())
    if small:
        sets = sets.join(named, "key", "left_semi")
    one, other = (sets.select(F.col("key").alias(x), F.col("items").alias(f"items_{x}")) for x in ("a", "b"))
    joined = pairs.join(one, "a").join(other, "b").withColumn("both", F.size(F.array_intersect("items_a", "items_b")))
    return joined.where(UNDER * F.col("both") >= OVER * (F.size("items_a") + F.size("items_b") - F.col("both"))).select("a", "b")


def pair(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def by_fingerprint(sets: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs (a, b) of the keys whose fingerprints are equal or linked by ``near``; the least key of a fingerprint stands for it."""
    heads = materialise(sets.groupBy("fp").agg(F.min("key").alias("head")))
    equal = sets.join(heads, "fp").where("key <> head").select(*pair(F.col("key"), F.col("head")))
    one, other = (heads.select(F.col("fp").alias(c), F.col("head").alias(f"head_{c}")) for c in ("a", "b"))
    linked = near(heads.select("fp")).join(one, "a").join(other, "b").select(*pair(F.col("head_a"), F.col("head_b")))
    return equal.union(linked).distinct()


def links(sets: DataFrame, near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, root) of the keys that similar pairs connect.  sets: key, n, items, and fp where ``near`` links fingerprints.  Only open shingles go on to the next round."""
    rooted = materialise(entered(sets).withColumn("root", F.col("key")))
    found = roots = None
    if near is not None:
        found = materialise(verified(by_fingerprint(sets, near), sets))
        roots = components(found)
    grown = roots is not None
    for k in range(ROUNDS + 1):
        if grown:
            moved = materialise(rooted.drop("root").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")))
            # shingles that one group alone holds have no more pairs, and groups only grow
            open_ = moved.groupBy("item").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("item")
            rooted = materialise(moved.join(open_, "item", "left_semi"))
            if rooted.isEmpty():
                break
        if k < ROUNDS:
            drawn = F.xxhash64("key", F.lit(k))
            head = F.min(F.struct(drawn.alias("h"), "key", "n", "pos", "root")).alias("head")
            if roots is None:
                heads = rooted.groupBy("item").agg(head)
            else:
                # members of the shingle's largest group, others each round
                sizes = rooted.groupBy("item", "root").agg(F.count("*").alias("members"))
                largest = sizes.groupBy("item").agg(F.max_by("root", F.struct("members", "root")).alias("root"))
                several = F.pmod(drawn, F.lit(1 if k < ROUNDS // 2 else HEADS))
                heads = rooted.join(largest, ["item", "root"]).groupBy("item", several).agg(head)
            asked = rooted.join(heads.select("item", "head"), "item").where((F.col("root") != F.col("head.root")) & may(F.col("n"), F.col("head.n"), F.col("pos"), F.col("head.pos")))
            asked = asked.groupBy("key", F.col("head.key").alias("other")).agg(F.count("*").alias("votes"))
            if k < ROUNDS // 2:
                asked = asked.groupBy("key").agg(F.max_by("other", F.struct("votes", "other")).alias("other"))
            pairs = asked.select(*pair(F.col("key"), F.col("other"))).distinct()
        else:
            x, y = rooted.alias("x"), rooted.alias("y")
            open_pairs = x.join(y, (F.col("x.item") == F.col("y.item")) & (F.col("x.key") < F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & may(F.col("x.n"), F.col("y.n"), F.col("x.pos"), F.col("y.pos")))
            pairs = open_pairs.select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()
        more = materialise(verified(pairs, sets))
        # without a new link groups and open shingles stay as they are
        grown = not more.isEmpty()
        if grown:
            found = more if found is None else found.union(more)
            roots = components(found)
    return components(sets.select(F.col("key").alias("a"), F.col("key").alias("b"))) if roots is None else roots


def groups(docs: DataFrame, shingle: int, fingerprint: Callable[[bytes, int], int] | None = None, near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """doc_id, key (of the set), component_id (the smallest id reachable over similar pairs) and ``first`` of every row.

    ``first`` holds for the rows of the group's least (id, key), so an id that several texts carry is judged text by text; rows without an id are ``first``.
    ``fingerprint`` of a text and links ``near`` fingerprints (fp) give the first candidates of the texts that may have a partner.
    """
    docs = text_and_id(docs)
    with scratch(docs.sparkSession):
        marked = materialise(shingled(docs, shingle, SHARE))
        some = materialise(sharing(marked))
        # texts stay where they are if the ids can be sent; otherwise both are shuffled
        ids, _ = sent_if_small(some.select(F.col("least").alias("id")).distinct())
        texts = docs.join(ids, docs["doc_id"].eqNullSafe(ids["id"]), "left_semi")
        # an id may stand for several texts
        own = shingled(texts, shingle, fingerprint=fingerprint).drop("doc_id")
        sets = materialise(own.join(some.select("key"), "key", "left_semi").dropDuplicates(["key"]))
        roots = links(sets, near)
        classes = marked.groupBy("key").agg(F.min("doc_id").alias("least"))
        joined = classes.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
        least = joined.groupBy("root").agg(F.min(F.when(F.col("least").isNotNull(), F.struct("least", "key"))).alias("head"))
        heads = joined.join(least, "root").select("key", F.col("head.least").alias("component_id"), F.col("head.key").alias("_head"))
        first = F.col("doc_id").isNull() | ((F.col("doc_id") == F.col("component_id")) & (F.col("key") == F.col("_head")))
        return materialise(marked.select("doc_id", "key").join(heads, "key").select("doc_id", "key", "component_id", first.alias("first")), keep=True)


def with_keys(docs: DataFrame, shingle: int) -> DataFrame:
    """row (all columns of docs), doc_id and key of every row; the columns' own names do not matter."""
    both = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                keys = [set_key(x) for x in shingle_sets(part.column("text"), shingle)]
                yield pa.record_batch([part.column("row"), part.column("doc_id"), pa.array(keys, pa.int64())], names=["row", "doc_id", "key"])

    return both.mapInArrow(run, T.StructType([both.schema["row"], T.StructField("doc_id", T.LongType()), T.StructField("key", T.LongType())]))
