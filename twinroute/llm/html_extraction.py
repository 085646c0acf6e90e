"""HTML extraction: content marginals of a tree-structured graphical model over DOM nodes.

Every node of a page's tree has a label, main text or not.  A node's potential is log-linear in its tag,
its names, and the length, links and punctuation of its own text and of the text below it; a
potential between parent and child depends on both labels and on the kind of child, and is normalised
over the child's label, so a child without evidence says nothing of its parent; nodes without names
share one vote among their like siblings, so many short paragraphs do not outvote their article.  Sum-product
messages go upward from the leaves and downward from the root, level by level over all pages of a
slice at once, and give each node's marginal.  Text runs of nodes with a marginal of one half or
more are the main text, joined in blocks.

The weights maximise the conditional likelihood of labelled pages (``labelled_pages``: ``TRAINING_PAGES`` pages
drawn from a grammar of page parts by a fixed seed, a documented bound), by Adam on the exact
gradient: observed minus expected counts under the marginals.  No page of the table is used to train, so a
page's text does not depend on the other pages.

Defined results: null or empty html gives an empty text; a page without markup is one block; repeated
rows, and rows with null ids, are pages of their own; texts of any length and trees of any depth are
read whole; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import labelled_pages, page_tree
from .tables import table
from .words import slices

TRAINING_PAGES, TRAINING_SEED, STEPS, RATE, DECAY = 700, 7, 160, 0.15, 1e-4
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_STOP = re.compile(r"[.!?…。！？]")
#: Stems that names are made of; a name that holds one counts as it (fixed values).
STEMS = """comment discus reply respons feedback sidebar widget related recommend popular trending footer copyright colophon imprint header masthead brand banner
advert sponsor promo cookie consent gdpr notice popup modal overlay paywall disclaim newsletter subscri signup login search form share sharing social follow
nav menu breadcrumb pagin pager toolbar tags archive content article entry story post body main text""".split()
PARAGRAPHS = frozenset("p li dd dt blockquote pre td th figcaption h1 h2 h3 h4 h5 h6 summary caption".split())


def _size(n: int, edges: tuple[int, ...] = (1, 20, 60, 150, 400, 1200)) -> int:
    return sum(n >= e for e in edges)


def features(tree: page_tree.Tree) -> Iterator[tuple[int, str]]:
    """(node, feature) pairs."""
    n = len(tree.tag)
    own, linked, stops = [0] * n, [0] * n, [0] * n
    for node, _, link, text in tree.runs:
        size = len(text.strip())
        own[node] += size
        linked[node] += size * link
        stops[node] += len(_STOP.findall(text)) if not link else 0
    below, below_linked, below_stops, paragraphs = own[:], linked[:], stops[:], [0] * n
    for v in range(n - 1, 0, -1):
        p = tree.parent[v]
        below[p] += below[v]
        below_linked[p] += below_linked[v]
        below_stops[p] += below_stops[v]
        paragraphs[p] += paragraphs[v] + (tree.tag[v] == "p" and own[v] > 0)
    share = lambda a, b: "-" if not b else "0" if a * 10 < b else "1" if a * 2 < b else "2"
    for v in range(n):
        tag = tree.tag[v]
        yield v, "bias"
        yield v, f"tag {tag}"
        for name in tree.names[v].split():
            low = name.lower()
            yield v, f"name {low}"
            for piece in {x.lower() for x in _PIECE.findall(name)}:
                yield v, f"piece {piece}"
            for stem in STEMS:
                if stem in low:
                    yield v, f"stem {stem}"
        if own[v]:
            kind = "p" if tag in PARAGRAPHS else "c"
            yield v, f"own {kind} {_size(own[v])}"
            yield v, f"own links {share(linked[v], own[v])} {_size(own[v]) > 2}"
            yield v, f"own stops {kind} {min(stops[v], 3)}"
        yield v, f"below {_size(below[v])} {share(below_linked[v], below[v])}"
        yield v, f"below stops {min(below_stops[v], 8)}"
        yield v, f"paragraphs {min(paragraphs[v], 5)}"
        if v == 0:
            yield v, "root"


def relation(tree: page_tree.Tree, v: int) -> int:
    """Kind of the edge from v to its parent: 0 a paragraph, 1 a container, 2 an element inside a line; plus 3 where v carries names."""
    tag = tree.tag[v]
    return (0 if tag in PARAGRAPHS else 1 if tag in page_tree.BLOCK else 2) + 3 * bool(tree.names[v].strip())


RELATIONS = 6


def votes(tree: page_tree.Tree) -> np.ndarray:
    """What a node's features count: one as a rule; a share of one for each of several nameless paragraph-like siblings of
    one tag; nothing for a nameless wrapper around a single node, which would repeat what its child says."""
    kinds = {t: k for k, t in enumerate(dict.fromkeys(tree.tag))}
    key = np.array(tree.parent) * len(kinds) + np.array([kinds[t] for t in tree.tag])
    plain = np.array([t in PARAGRAPHS and not x.strip() for t, x in zip(tree.tag, tree.names, strict=True)])
    _, group, like = np.unique(np.where(plain, key, -1), return_inverse=True, return_counts=True)
    children = np.bincount(np.array(tree.parent[1:], np.int64), minlength=len(key))
    bare = np.array([t in ("div", "center") and not x.strip() for t, x in zip(tree.tag, tree.names, strict=True)])
    bare[[node for node, _, _, text in tree.runs if text.strip()]] = False
    return np.where(plain, 1 / like[group], np.where(bare & (children == 1), 0.0, 1.0))


@dataclass
class Forest:
    """Nodes of many pages: parents (-1 at roots), nodes by depth, relations, and (node, feature, value) entries."""

    parent: np.ndarray
    levels: list[np.ndarray]
    relation: np.ndarray
    node: np.ndarray
    feature: np.ndarray
    value: np.ndarray
    first: np.ndarray


def forest(trees: list[page_tree.Tree], known: dict[str, int], grow: bool = False) -> Forest:
    first = np.cumsum([0, *(len(t.tag) for t in trees)])
    parent = np.concatenate([np.where(np.array(t.parent) < 0, -1, np.array(t.parent) + f) for t, f in zip(trees, first, strict=False)]) if trees else np.zeros(0, np.int64)
    depth = np.concatenate([np.array(t.depth) for t in trees]) if trees else np.zeros(0, np.int64)
    kind = np.concatenate([[relation(t, v) for v in range(len(t.tag))] for t in trees]).astype(np.int64) if trees else np.zeros(0, np.int64)
    share = np.concatenate([votes(t) for t in trees]) if trees else np.zeros(0)
    nodes, found = [], []
    for t, f in zip(trees, first, strict=False):
        for v, name in features(t):
            k = known.setdefault(name, len(known)) if grow else known.get(name)
            if k is not None:
                nodes.append(v + f)
                found.append(k)
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(int(depth.max(initial=-1)) + 2))
    node = np.array(nodes, np.int64)
    return Forest(parent, [order[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], kind, node, np.array(found, np.int64), share[node], first)


def sum_product(trees: Forest, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marginals n x 2, pair marginals n x parent label x label; zero at roots).

    unary: n x 2 log potentials; pair: relations x parent label x label.
    """
    belief, psi = unary.copy(), pair[trees.relation]
    up = np.zeros_like(unary)
    for level in trees.levels[:0:-1]:
        # message to the parent: sum over the child's label
        up[level] = np.logaddexp.reduce(psi[level] + belief[level][:, None, :], axis=2)
        np.add.at(belief, trees.parent[level], up[level])
    edge = np.zeros((len(unary), 2, 2))
    for level in trees.levels[1:]:
        # what the parent knows without this child
        rest = belief[trees.parent[level]] - up[level]
        joint = rest[:, :, None] + psi[level] + belief[level][:, None, :]
        edge[level] = np.exp(joint - np.logaddexp.reduce(joint, axis=(1, 2), keepdims=True))
        belief[level] = belief[level] + np.logaddexp.reduce(rest[:, :, None] + psi[level], axis=1)
    return np.exp(belief - np.logaddexp.reduce(belief, axis=1, keepdims=True)), edge


@dataclass
class Model:
    features: dict[str, int]
    weights: np.ndarray
    pair: np.ndarray

    def potentials(self, trees: Forest) -> np.ndarray:
        score = np.bincount(trees.node, self.weights[trees.feature] * trees.value, len(trees.parent))
        return np.column_stack([-score / 2, score / 2])


def labels(tree: page_tree.Tree) -> np.ndarray:
    """Labels of a marked page: a mark holds for what is below; an unmarked node above is main text if most text below is."""
    n = len(tree.tag)
    given = [None] * n
    for v in range(n):
        given[v] = int(tree.mark[v]) if tree.mark[v] is not None else given[tree.parent[v]] if v else None
    text = np.zeros((n, 2))
    for node, _, _, run in tree.runs:
        text[node, given[node] or 0] += len(run.strip())
    for v in range(n - 1, 0, -1):
        text[tree.parent[v]] += text[v]
    return np.array([text[v, 1] > text[v, 0] if given[v] is None else given[v] for v in range(n)], np.int64)


def train(pages: Iterable[str], steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> Model:
    """Weights of most conditional likelihood on marked pages."""
    trees = [page_tree.parse(p) for p in pages]
    known: dict[str, int] = {}
    wood = forest(trees, known, grow=True)
    truth = np.concatenate([labels(t) for t in trees])
    child = wood.parent >= 0
    seen = np.zeros((RELATIONS, 2, 2))
    np.add.at(seen, (wood.relation[child], truth[wood.parent[child]], truth[child]), 1)
    model, edges = Model(known, np.zeros(len(known)), np.zeros((RELATIONS, 2, 2))), np.zeros((RELATIONS, 2, 2))
    n, moments = len(trees), [np.zeros((2, len(known))), np.zeros((2, RELATIONS, 2, 2))]
    for step in range(1, steps + 1):
        model.pair = edges - np.logaddexp.reduce(edges, axis=2, keepdims=True)
        p, edge = sum_product(wood, model.potentials(wood), model.pair)
        expected = np.zeros_like(seen)
        np.add.at(expected, wood.relation[child], edge[child])
        more = seen - expected
        slopes = (
            np.bincount(wood.feature, (truth - p[:, 1])[wood.node] * wood.value, len(known)) / n - decay * model.weights,
            (more - np.exp(model.pair) * more.sum(axis=2, keepdims=True)) / n - decay * edges,
        )
        for m, slope, at in zip(moments, slopes, (model.weights, edges), strict=True):
            m[0] = 0.9 * m[0] + 0.1 * slope
            m[1] = 0.99 * m[1] + 0.01 * slope**2
            at += rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    model.pair = edges - np.logaddexp.reduce(edges, axis=2, keepdims=True)
    return model


@lru_cache(maxsize=1)
def trained() -> Model:
    return train(labelled_pages.pages(TRAINING_PAGES, TRAINING_SEED))


def main_texts(pages: list[str | None], model: Model, threshold: float = 0.5) -> list[str]:
    """The main text of each page."""
    trees = [page_tree.parse(p or "") for p in pages]
    wood = forest(trees, model.features)
    p, _ = sum_product(wood, model.potentials(wood), model.pair)
    keep = p[:, 1] >= threshold
    return ["\n".join(page_tree.block_texts(t, keep[a:b])) for t, a, b in zip(trees, wood.first, wood.first[1:], strict=False)]


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page; rows stay where they are."""
    sent = pages.sparkSession.sparkContext.broadcast(model or trained())
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = main_texts(part.column("html").to_pylist(), sent.value)
                yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return plain.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
