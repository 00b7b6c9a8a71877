"""Quality rules: base rules, then gradient-boosted trees over document statistics, flattened into numpy node arrays.

Trees are grown on the driver from a bounded sample of labelled rows, over histograms of FEATURES, with logistic loss. Features
named in MONOTONE may only move a score one way: a split whose leaves go the other way is not taken, and the children's values
are held on their side of the parent's middle. All trees live in five flat arrays; a batch of documents walks them level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lakeferry.llm.docstats import BASE, FEATURES, document_stats, features, sample_features, text_rows
from lakeferry.llm.textcore import slices
from lakeferry.runtime import ship

#: Labelled rows that training sees, at most.
TRAIN_ROWS = 20_000
#: A document that passes the base rules is kept if its chance of quality 1 is this or more.
KEEP_AT = 0.3
#: Direction in which quality may go as a feature grows.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "bang_share": -1, "upper_share": -1}
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30


@dataclass
class Forest:
    """Trees as flat arrays; a leaf has itself as both children. ``roots``: each tree's first node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    bias: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def _grow(binned, edges, g, h, depth, signs, ridge, least, rate):
    """One tree: [(feature, threshold, left, right, value)], by repeatedly splitting a node at its best gain."""
    nodes = []

    def leaf(rows, low, high):
        return float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), low, high))

    def build(rows, level, low, high):
        me = len(nodes)
        nodes.append([0, 0.0, me, me, rate * leaf(rows, low, high)])
        if level == depth or len(rows) < 2 * least:
            return me
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        for f, e in enumerate(edges):
            if not len(e):
                continue
            b = binned[rows, f]
            size = len(e) + 1
            gs, hs, ns = (np.cumsum(np.bincount(b, weights=w, minlength=size))[:-1] for w in (g[rows], h[rows], None))
            left, right = np.clip(-gs / (hs + ridge), low, high), np.clip(-(total_g - gs) / (total_h - hs + ridge), low, high)
            gain = gs**2 / (hs + ridge) + (total_g - gs) ** 2 / (total_h - hs + ridge) - total_g**2 / (total_h + ridge)
            ok = (ns >= least) & (len(rows) - ns >= least)
            if signs[f]:
                ok &= signs[f] * (right - left) >= 0
            gain = np.where(ok, gain, -1.0)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (f, k, left[k], right[k]))
        if best[1] is None:
            return me
        f, k, left, right = best[1]
        mid = (left + right) / 2
        bounds = ((low, high), (low, high)) if not signs[f] else ((low, mid), (mid, high)) if signs[f] > 0 else ((mid, high), (low, mid))
        goes = binned[rows, f] <= k
        nodes[me][0], nodes[me][1] = f, float(edges[f][k])
        nodes[me][2] = build(rows[goes], level + 1, *bounds[0])
        nodes[me][3] = build(rows[~goes], level + 1, *bounds[1])
        return me

    build(np.arange(len(g)), 0, -6.0, 6.0)
    return nodes


def fit_forest(x, y, monotone=None, trees=60, depth=3, rate=0.2, bins=64, ridge=1.0, least=8) -> Forest:
    """Boosted trees for y in {0, 1}. With labels of one kind, or none, every document gets the share of 1s (none: 1/2)."""
    signs = [(MONOTONE if monotone is None else monotone).get(f, 0) for f in FEATURES[: x.shape[1]]]
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(share / (1 - share)))
    # thresholds stand halfway between values
    edges = []
    for j in range(x.shape[1]):
        v = np.unique(x[:, j])
        if len(v) > bins:
            v = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)))
        edges.append((v[1:] + v[:-1]) / 2)
    binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)]) if len(x) else np.zeros((0, x.shape[1]), int)
    flat, roots, raw = [], [], np.full(len(y), bias)
    for _ in range(trees if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-raw))
        nodes = _grow(binned, edges, p - y, np.maximum(p * (1 - p), 1e-6), depth, signs, ridge, least, rate)
        roots.append(len(flat))
        flat += [[f, t, a + roots[-1], b + roots[-1], v] for f, t, a, b, v in nodes]
        one = Forest(*(np.array([n[k] for n in nodes]) for k in range(5)), np.array([0]), 0.0, depth)
        raw += one.raw(x)
    cols = [np.array([n[k] for n in flat], dtype=float if k in (1, 4) else int) for k in range(5)]
    return Forest(*cols, np.array(roots, int), bias, depth)


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


def apply_rules(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS, keep_at: float = KEEP_AT) -> DataFrame:
    """``docs(doc_id, text)``, ``labels(doc_id, quality)`` -> doc_id, the counts of BASE, base_failed, chance, kept; a row per row.

    Null and empty texts count as no words, so they fail the base rules. Rows that repeat are judged each, alike. Very long
    texts are counted whole. With no labels, or of one kind, the base rules alone decide. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    forest = docs.sparkSession.sparkContext.broadcast(fit_forest(*sample_features(docs, labels, "quality", limit)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, bounds in slices(batch.column(1)):
                s = document_stats(buf, bounds)
                chance, failed = forest.value.chance(features(s)), base_failed(s)
                arrays = [pa.array(s[c].astype(np.int64)) for c in BASE]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], *arrays, pa.array(failed), pa.array(chance), pa.array(~failed & (chance >= keep_at))], ["doc_id", *BASE, "base_failed", "chance", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return text_rows(docs).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, chance double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; nothing is shuffled."""
    ship(docs.sparkSession)
    forest = docs.sparkSession.sparkContext.broadcast(fit_forest(*sample_features(docs, labels, "quality", limit)))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, j, buf, bounds in slices(batch.column(at)):
                s = document_stats(buf, bounds)
                keep[i:j] = ~base_failed(s) & (forest.value.chance(features(s)) >= keep_at)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
