"""Toxicity by weak supervision.

Voters come from a bounded labelled sample: words (a lexicon) and word beginnings (patterns)
that labelled toxic documents hold far more often than others; the annotator's label votes too.  A
generative label model, a two-class mixture of Bernoulli votes, estimates by expectation
maximisation how often each voter fires in either class and how voters correlate within a class;
correlated voters share their weight.  A sparse linear classifier is trained on its posterior
labels and scores every whole text inside the tasks.

Only the sample is bounded (``MAX_TOXIC`` and ``MAX_OTHER`` labelled rows, picked by a hash of the
id); every text is scored.  Scores use the text alone.

Defined results: a text that is null or empty gets the score of no evidence (the intercept);
null ids are never learned from; a row labelled more than once counts with its largest label;
without a toxic and a clean label nothing is learned and every score is 0; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .language_id import remainder
from .tables import table, text_and_id
from .words import SpanHash, slices, split

MAX_TOXIC = 4_000
MAX_OTHER = 12_000
#: Voters whose correlations are computed at once.
BLOCK = 128
PREFIX_BYTES = 6
MIN_DOCS = 4

_GAP = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
_PREFIX_SALT = np.uint64(0x5851F42D4C957F2D)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of every word and every word beginning, repeats included."""
    words = split(pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")), space=_GAP)
    doc = words.doc_of()
    long = words.end - words.start > PREFIX_BYTES + 1
    begin = words.start[long]
    prefix = SpanHash(words.data.astype(np.uint64), 0x9E3779B97F4A7C15).of(begin, begin + PREFIX_BYTES) ^ _PREFIX_SALT
    return np.r_[doc, doc[long]], np.r_[words.hash, prefix]


@dataclass
class Linear:
    """Sparse weights by sorted feature hash."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Probability of a toxic text; each feature counts once."""
        total = np.full(len(texts), self.bias)
        if len(self.keys):
            doc, feature = features(texts)
            at = np.minimum(np.searchsorted(self.keys, feature), len(self.keys) - 1)
            hit = self.keys[at] == feature
            pairs = np.unique(doc[hit] * len(self.keys) + at[hit])
            np.add.at(total, pairs // len(self.keys), self.weights[pairs % len(self.keys)])
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def sample(labels: DataFrame, max_toxic: int = MAX_TOXIC, max_other: int = MAX_OTHER) -> DataFrame:
    """At most so many labelled rows (doc_id, toxic) of each kind, by a hash of the id."""
    one = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    pick = lambda toxic, n: one.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    return pick(1, max_toxic).unionByName(pick(0, max_other))


def vectors(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """(doc_id, toxic, found): the distinct features of the sample's documents, as packed 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                doc, feature = features(part.column("text"))
                order = np.argsort(doc, kind="stable")
                of = np.split(feature[order], np.searchsorted(doc[order], np.arange(1, part.num_rows)))
                rows = [np.unique(x).tobytes() for x in of]
                yield pa.record_batch([part.column("doc_id"), part.column("toxic"), pa.array(rows, pa.binary())], names=["doc_id", "toxic", "found"])

    # the sample has a fixed bound, so it may be broadcast
    return text_and_id(docs).join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, found binary")


@dataclass
class Votes:
    """Firing voters as (document, voter) pairs, the last voter being the annotator."""

    doc: np.ndarray
    voter: np.ndarray
    n_docs: int
    n_voters: int


def label_model(votes: Votes, given: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of every document, firing rates by class (2, voters), weights): the fitted mixture."""
    post = np.where(given > 0, 0.95, 0.05)
    fires = np.zeros((votes.n_docs, votes.n_voters), dtype=np.float32)
    fires[votes.doc, votes.voter] = 1
    weights, rates = np.ones(votes.n_voters), np.zeros((2, votes.n_voters))
    annotator = votes.n_voters - 1
    for _ in range(rounds):
        mass = np.array([(1 - post).sum(), post.sum()])
        rates = (np.stack([(1 - post) @ fires, post @ fires]) + 0.5) / (mass[:, None] + 1)
        # the annotator is held to be mostly right; without that the classes may drift to another split
        rates[:, annotator] = np.clip(rates[:, annotator], [0, 0.9], [0.02, 1 - 1e-3])
        # correlation inside the toxic class beyond what the class explains
        share, held = post.astype(np.float32), rates[1]
        sums, total, n = share @ fires, share.sum(), votes.n_voters
        spread = np.sqrt(np.maximum(sums - 2 * held * sums + held**2 * total, 0)) + 1e-9
        ties = np.zeros(n)
        for lo in range(0, n, BLOCK):  # a block of voters against all, so that memory follows the votes
            own = slice(lo, min(lo + BLOCK, n))
            both = (fires[:, own] * share[:, None]).T @ fires
            both += -np.outer(held[own], sums) - np.outer(sums[own], held) + total * np.outer(held[own], held)
            tied = np.abs(both / np.outer(spread[own], spread))
            tied[np.arange(tied.shape[0]), np.arange(own.start, own.stop)] = tied[:, annotator] = 0
            ties[own] = np.where(tied > 0.3, tied, 0).sum(axis=1)
        ties[annotator] = 0
        weights = 1 / (1 + ties)
        # a lexicon or pattern voter abstains when it does not fire, the annotator never does
        fire, quiet = np.log(rates[1] / rates[0]), np.log((1 - rates[1, annotator]) / (1 - rates[0, annotator]))
        odds = np.log(mass[1] / mass[0]) + fires @ (weights * fire) + (1 - fires[:, annotator]) * weights[annotator] * quiet
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post, rates, weights


def fit(found: list[np.ndarray], toxic: np.ndarray, steps: int = 400, penalty: float = 2e-5) -> Linear:
    """The classifier from the sample's feature lists and labels."""
    n, n_toxic = len(found), int(toxic.sum())
    if not n_toxic or n_toxic == n:
        return Linear(np.zeros(0, np.uint64), np.zeros(0), -50.0)
    sizes = np.array([len(f) for f in found])
    doc = np.repeat(np.arange(n, dtype=np.int32), sizes)
    keys, at = np.unique(np.concatenate(found), return_inverse=True)
    at = at.astype(np.int32)
    df = np.bincount(at)
    keep = df >= MIN_DOCS
    new = np.cumsum(keep) - 1
    hit = keep[at]
    keys, doc, at = keys[keep], doc[hit], new[at[hit]]
    if not len(keys):
        return Linear(keys, np.zeros(0), float(np.log(n_toxic / (n - n_toxic))))
    df = np.bincount(at, minlength=len(keys))
    positive = np.bincount(at, weights=toxic[doc], minlength=len(keys))
    odds = np.log((positive + 0.5) / (n_toxic + 1)) - np.log((df - positive + 0.5) / (n - n_toxic + 1))
    strong = np.flatnonzero((odds > 2.5) & (positive >= MIN_DOCS))
    place = np.full(len(keys), -1)
    place[strong] = np.arange(len(strong))
    firing = place[at] >= 0
    noted = np.flatnonzero(toxic > 0)
    votes = Votes(np.r_[doc[firing], noted], np.r_[place[at[firing]], np.full(len(noted), len(strong))], n, len(strong) + 1)
    post, _, _ = label_model(votes, toxic)

    # the classifier sees features that speak for one class; the rest would only fit single texts
    clear = np.abs(odds) > 1.5
    new = np.cumsum(clear) - 1
    hit = clear[at]
    keys, doc, at = keys[clear], doc[hit], new[at[hit]]

    weights, bias = np.zeros(len(keys)), float(np.log(max(post.mean(), 1e-6) / max(1 - post.mean(), 1e-6)))
    squares = np.full(len(keys), 1e-8)
    cost = np.where(post > 0.5, 0.5 / max((post > 0.5).mean(), 1e-6), 0.5 / max((post <= 0.5).mean(), 1e-6)) ** 0.5
    for _ in range(steps):
        margin = bias + np.bincount(doc, weights=weights[at], minlength=n)
        error = cost * (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - post) / n
        slope = np.bincount(at, weights=error[doc], minlength=len(keys)) + penalty * weights
        squares += slope**2
        weights -= 0.3 * slope / np.sqrt(squares)
        # rare evidence must not add up: small weights shrink to nothing
        weights = np.sign(weights) * np.maximum(np.abs(weights) - 0.0005, 0)
        bias -= 2 * error.sum()
    used = weights != 0
    return Linear(keys[used], weights[used], bias)


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_other: int = MAX_OTHER) -> Linear:
    """Fitted on the bounded labelled sample."""
    rows = sorted(vectors(docs, sample(labels, max_toxic, max_other)).collect(), key=lambda r: (r["doc_id"], r["found"]))
    return fit([np.frombuffer(r["found"], dtype=np.uint64) for r in rows], np.array([r["toxic"] for r in rows], dtype=float))


def score(docs: DataFrame, model: Linear) -> DataFrame:
    """The columns besides text, and the score of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("text", "score")]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.record_batch([*(part.column(c) for c in names), pa.array(sent.value.scores(part.column("text")))], names=[*names, "score"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(names).schema)
    return docs.mapInArrow(run, f"{kinds}, score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text_and_id(table(spark, sf_dir, "documents"))
    labels = table(spark, sf_dir, "labels").where(remainder(F.col("doc_id"), 5) != 0)
    held = docs.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "text")
    return score(held, train(docs, labels)).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
