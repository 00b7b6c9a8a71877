"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is linear in its features. Every labelled document of label 1 is compared with every one of label 0: the fit has the
least mean logistic loss of all differences of their strengths. The threshold is the quantile of the training strengths at the share of label 0.

A pair's loss hangs on two strengths alone, so a label's strengths go to a grid, each shared out between its two neighbours, and a document
meets all of the other label at once there. A Newton step is two passes over the rows, which add up to vectors of bounded length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeferry.llm.docstats import FEATURES, document_stats, features, held_out, text_rows
from lakeferry.llm.textcore import slices
from lakeferry.runtime import materialize, ship

#: Nodes of the grid of strengths, at most twice that; of the coarse one, which only curvature is told by.
GRID, COARSE = 1 << 12, 128
#: The score that the quantile threshold is put at.
PREDICT_AT = 0.3
KNOTS = np.array([-1.0, 0.0, 1.0, 2.0])
#: ``total(f)``: the sum of the vectors ``f(features, labels)`` over all training rows.
Total = Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray]], np.ndarray]


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    knots: np.ndarray
    weights: np.ndarray
    threshold: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return _basis(x, self.mean, self.scale, self.knots) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.clip(self.strength(x) - self.threshold, -40, 40)
        return 1 / (1 + np.exp(-at) * (1 - PREDICT_AT) / PREDICT_AT)


def _basis(x, mean, scale, knots) -> np.ndarray:
    """Standardised features, and of each the part above its knots, so that strengths can bend."""
    z = np.clip((x - mean) / scale, -8, 8)
    return np.concatenate([z, *[np.maximum(z - k, 0) for k in knots]], axis=1)


def preference_pairs(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (better, worse) of all pairs that a fit compares."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    return np.repeat(good, len(bad)), np.tile(bad, len(good))


def _shared_out(s: np.ndarray, low: float, step: float, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """(node to the left, share of the node to its right) of every strength."""
    at = np.clip((s - low) / step, 0, nodes - 1)
    left = np.minimum(at.astype(np.int64), nodes - 2)
    return left, at - left


def _deposit(s: np.ndarray, weights: np.ndarray | None, low: float, step: float, nodes: int) -> np.ndarray:
    left, share = _shared_out(s, low, step, nodes)
    w = 1.0 if weights is None else weights
    return np.bincount(left, (1 - share) * w, nodes) + np.bincount(left + 1, share * w, nodes)


def _meet(counts: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """At every node i the sum of counts[k] * kernel(k - i); ``kernel`` begins at the least difference."""
    n = len(counts)
    size = 1 << (3 * n).bit_length()
    return np.fft.irfft(np.fft.rfft(counts, size) * np.fft.rfft(kernel[::-1], size), size)[n - 1 : 2 * n - 1]


def _chance(d: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(d, -40, 40)))


def _span(model: Ranker, low: np.ndarray, high: np.ndarray) -> tuple[float, float]:
    """Bounds of the strengths of rows whose features are within ``low`` and ``high``: what a feature adds is bent at its knots only."""
    z = np.clip((np.stack([low, high]) - model.mean) / model.scale, -8, 8)
    at = np.concatenate([z, np.clip(np.repeat(model.knots[:, None], z.shape[1], 1), z[0], z[1])])
    w = model.weights.reshape(-1, z.shape[1])
    parts = at * w[0] + sum(np.maximum(at - k, 0) * w[1 + j] for j, k in enumerate(model.knots))
    return float(parts.min(0).sum()), float(parts.max(0).sum())


def fit_weights(total: Total, model: Ranker, low: np.ndarray, high: np.ndarray, good: int, bad: int, ridge: float = 1e-2, steps: int = 40) -> None:
    """Newton steps on the mean logistic loss of all pairs of ``good`` and ``bad`` rows, with half of ``ridge`` times the weights' squares."""
    k, step, pairs = len(model.weights), 0.0, float(good) * float(bad)
    for _ in range(steps):
        least, most = _span(model, low, high)
        # steps of the grid are powers of 2 that only grow and nodes their multiples, so that the last rounds have one grid
        step = max(step, 2.0 ** np.ceil(np.log2(max(most - least, 1.0) / GRID)))
        first = step * np.floor(least / step)
        nodes = int(np.ceil((most - first) / step)) + 2
        coarse = max(4 * step, (nodes * step) / COARSE, 0.25)
        coarse_nodes = int(np.ceil(nodes * step / coarse)) + 2

        def counts(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            s = model.strength(x)
            return np.concatenate([_deposit(s[y == label], None, first, step, nodes) for label in (0, 1)])

        worse, better = total(counts).reshape(2, nodes)
        apart = step * np.arange(1 - nodes, nodes)
        lose = _chance(apart)
        # what all of the other label push a row at a node by, and how that changes: of label 0, then of label 1
        push = np.stack([-_meet(better, lose[::-1]), _meet(worse, lose)])
        bend = np.stack([_meet(better, lose * (1 - lose)), _meet(worse, lose * (1 - lose))])

        def slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            phi, out = _basis(x, model.mean, model.scale, model.knots), [np.zeros(k), np.zeros((k, k))]
            s = phi @ model.weights
            for label in (0, 1):
                rows = y == label
                own = phi[rows]
                left, share = _shared_out(s[rows], first, step, nodes)
                at = lambda v: v[left] * (1 - share) + v[left + 1] * share  # noqa: B023, E731
                out[0] = out[0] + own.T @ at(push[label])
                out[1] = out[1] + (own * at(bend[label])[:, None]).T @ own
                out.append(np.stack([_deposit(s[rows], own[:, j], first, coarse, coarse_nodes) for j in range(k)]))
            return np.concatenate([o.ravel() for o in out])

        got = total(slopes)
        slope, square, by_node = got[:k], got[k : k + k * k].reshape(k, k), got[k + k * k :].reshape(2, k, coarse_nodes)
        chance = _chance(coarse * (np.arange(coarse_nodes)[:, None] - np.arange(coarse_nodes)))
        cross = by_node[0] @ (chance * (1 - chance)) @ by_node[1].T
        move = np.linalg.solve((square - cross - cross.T) / pairs + ridge * np.eye(k), ridge * model.weights - slope / pairs)
        model.weights = model.weights - move
        if np.abs(move).max() < 1e-8:
            break


def _ranker(mean: np.ndarray, deviation: np.ndarray) -> Ranker:
    return Ranker(mean, deviation + 1e-6, KNOTS, np.zeros(len(mean) * (1 + len(KNOTS))), 0.0)


def fit_ranker(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> Ranker:
    """The model of rows in memory. Without pairs all strengths are 0, at the threshold."""
    good, bad = int((y == 1).sum()), int((y == 0).sum())
    model = _ranker(x.mean(0), x.std(0)) if len(x) else _ranker(np.zeros(x.shape[1]), np.ones(x.shape[1]))
    if good and bad:
        fit_weights(lambda f: f(x, y), model, x.min(0), x.max(0), good, bad, ridge)
    s = np.sort(model.strength(x))
    # halfway between the two strengths on either side of the quantile
    model.threshold = float((s[bad - 1] + s[bad]) / 2) if 0 < bad < len(s) else 0.0
    return model


def _either_side(strengths: DataFrame, rank: int) -> tuple[float, float]:
    """The ``rank``-th least value of strengths(s) and the next, by narrowing bins down to one value; none is held but the bins."""
    low, high = strengths.agg(F.min("s"), F.max("s")).first()
    below = 0
    while low < high:
        at = F.least(F.floor((F.col("s") - low) / F.lit((high - low) / 1024)), F.lit(1023))
        for _, n, low_, high_ in strengths.filter(F.col("s").between(low, high)).groupBy(at.alias("b")).agg(F.count(F.lit(1)), F.min("s"), F.max("s")).orderBy("b").collect():  # 1024 rows at most
            if below + n >= rank:
                low, high = low_, high_
                break
            below += n
    up_to, after = strengths.agg(F.count(F.when(F.col("s") <= low, 1)), F.min(F.when(F.col("s") > low, F.col("s")))).first()
    return low, low if up_to > rank else after


def train(known: DataFrame) -> Ranker:
    """The model of all rows of known(label, FEATURES), as ``fit_ranker`` has it of rows in memory."""
    n = len(FEATURES)

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        return np.column_stack([batch.column(1 + j).to_numpy() for j in range(n)])

    def total(f: Callable) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for batch in batches:
                if batch.num_rows:
                    part = f(matrix(batch), batch.column(0).to_numpy())
                    out = part if out is None else out + part
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["v"])

        return sum(np.frombuffer(r[0]) for r in known.mapInArrow(run, "v binary").collect())  # a vector for each task

    stats = [g(F.col(c)) for g in (F.avg, F.stddev_pop, F.min, F.max) for c in FEATURES]
    rows, good, bad, *of = known.agg(F.count(F.lit(1)), F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0), *stats).first()
    if not rows:
        return _ranker(np.zeros(n), np.ones(n))
    mean, deviation, low, high = np.array(of, float).reshape(4, n)
    model = _ranker(mean, deviation)
    if good and bad:
        fit_weights(total, model, low, high, good, bad)

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.strength(matrix(batch)))], ["s"])

    if 0 < bad < rows:
        model.threshold = sum(_either_side(materialize(known.mapInArrow(strengths, "s double"), "strengths", plain=True), bad)) / 2
    return model


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs(doc_id, text)``, ``labels(doc_id, quality)`` -> doc_id, held_out, score, predicted; a row per row of ``docs``.

    Every labelled row that is not held out trains. Null labels don't count; of a document labelled twice the least label does.
    Null and empty texts are scored as documents whose features are all 0. Rows that repeat are scored each, alike. Without labels of
    both kinds every score is PREDICT_AT. An empty table gives no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, bounds in slices(batch.column(1)):
                x = features(document_stats(buf, bounds)).astype(float)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(2)[i:j], *[pa.array(c) for c in x.T]], ["doc_id", "held_out", *FEATURES])

    measured = text_rows(docs, held_out().alias("held_out")).mapInArrow(measure, f"doc_id {kind}, held_out boolean, " + ", ".join(f"{f} double" for f in FEATURES))
    measured = materialize(measured, "measured", plain=True)
    label = labels.filter(F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("label"))
    known = materialize(measured.filter("NOT held_out").join(label, "doc_id").select("label", *FEATURES), "known", plain=True)
    model = spark.sparkContext.broadcast(train(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.value.score(np.column_stack([batch.column(2 + j).to_numpy() for j in range(len(FEATURES))]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= PREDICT_AT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return measured.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
