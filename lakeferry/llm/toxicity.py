"""Toxic passages by maximum-scoring segments of token log-odds, aggregated by extreme-value calibration.

A token's score is the log-odds of toxic over clean labelled text under a Dirichlet prior whose means are the token's share of
the whole corpus, moved towards 0 by Z standard deviations, less a drift that makes the mean score of clean text negative. A
token without a score of its own has that of the longest of its beginnings, of PREFIXES characters, that has one: words are inflected and compounded behind their
stems. Tokens are counted once for each labelled document, beginnings once for
each different token, so that neither a text that repeats itself nor one frequent word speaks for more than it is. In
a text, one pass over the scores finds all maximal scoring segments. For clean text of n tokens the best segment's score x has
chance 1 - exp(-K n e^(-lambda x)) of arising; lambda solves E[e^(lambda s)] = 1 and K is fitted. A segment is significant if K n e^(-lambda x)
is below E_VALUE. A document's evidence is the sum of -log of that over its significant segments, and a logistic curve fitted to labelled
documents turns it into a score.

Z, the drift and the use of beginnings were chosen by the log loss of cross-validation over training rows alone (README).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeferry.llm.docstats import held_out, labelled_sample, text_rows
from lakeferry.llm.textcore import LOWER, find_words, hash_spans, segment_ids, slices
from lakeferry.runtime import materialize, ship

#: Labelled documents that training sees at most. Tokens have scores if LEAST of these have them, so their number is bounded by this too.
TRAIN_ROWS = 20_000
#: Weight of the prior, in tokens; floor of a token's prior count; standard deviations of doubt; least count of a scored token.
PRIOR, FLOOR, Z, LEAST = 1000.0, 0.5, 2.0, 5
#: Characters of a token's beginnings, the longest first; each is shorter than the token.
PREFIXES = (8, 7, 6, 5, 4, 3)
#: Clean text's mean score is this far below 0 at least.
DRIFT = 1.0
E_VALUE = 0.05
PREDICT_AT = 0.5

#: Tokens are runs of ASCII letters, digits and bytes of other scripts.
GAP = np.ones(256, bool)
GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass
class Tokens:
    """The tokens of some texts, letters A-Z taken as a-z: of each its hash and bounds in ``buf``; first token of each document and one more."""

    buf: np.ndarray
    h: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    per: np.ndarray

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, a place of each, which one each token is)"""
        return np.unique(self.h, return_index=True, return_inverse=True)

    def prefixes(self, at: np.ndarray) -> np.ndarray:
        """(tokens ``at``, PREFIXES): hashes of their beginnings, 0 where the token is no longer than that."""
        lead = np.append(np.flatnonzero((self.buf & 0xC0) != 0x80), len(self.buf))
        first = np.searchsorted(lead, self.starts[at])
        out = np.zeros((len(at), len(PREFIXES)), np.uint64)
        for j, k in enumerate(PREFIXES):
            end = lead[np.minimum(first + k, len(lead) - 1)]
            has = np.flatnonzero(end < self.ends[at])
            out[has, j] = hash_spans(self.buf, self.starts[at][has], end[has]) ^ np.uint64(0x5BD1E9955BD1E995)
        return out


def tokens(buf: np.ndarray, bounds: np.ndarray) -> Tokens:
    buf = LOWER[buf]
    starts, ends, per = find_words(buf, bounds, GAP)
    return Tokens(buf, hash_spans(buf, starts, ends), starts, ends, per)


@dataclass
class Odds:
    """Log-odds of tokens and beginnings by their sorted hashes, the drift, and the calibration."""

    keys: np.ndarray
    scores: np.ndarray
    drift: float = DRIFT
    lam: float = 1.0
    k: float = 0.1
    slope: float = 1.0
    at: float = 1.0

    def _find(self, h: np.ndarray) -> np.ndarray:
        i = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[i] == h, self.scores[i], 0.0)

    def of(self, found: Tokens) -> np.ndarray:
        """The tokens' scores."""
        if not len(self.keys):
            return np.full(len(found.h), -self.drift)
        h, at, which = found.distinct()
        own = self._find(h)
        bare = np.flatnonzero(own == 0)
        # the longest beginning that has a score
        by_length = self._find(found.prefixes(at[bare]))
        own[bare] = by_length[np.arange(len(bare)), np.argmax(by_length != 0, axis=1)]
        return own[which] - self.drift

    def log_e(self, score: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Log of the expected number of clean segments of this score in n tokens."""
        return np.log(self.k * np.maximum(n, 1)) - self.lam * score

    def evidence(self, s: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int, float]]]]:
        """(evidence, best segment's score, significant segments) of each document."""
        n = len(per) - 1
        total, best, found = np.zeros(n), np.zeros(n), [[] for _ in range(n)]
        hot = np.unique(np.searchsorted(per, np.flatnonzero(s > 0), "right") - 1)
        for d in hot:
            parts = maximal_segments(s[per[d] : per[d + 1]])
            best[d] = max(p[2] for p in parts)
            log_e = self.log_e(np.array([p[2] for p in parts]), np.array([per[d + 1] - per[d]]))
            found[d] = [p for p, e in zip(parts, log_e, strict=True) if e < np.log(E_VALUE)]
            total[d] = -log_e[log_e < np.log(E_VALUE)].sum()
        return total, best, found

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (np.log1p(evidence) - self.at), -40, 40)))


def maximal_segments(s: np.ndarray) -> list[tuple[int, int, float]]:
    """[(first, after the last, score)] of all maximal scoring segments of ``s``, in linear time.

    Neighbours of one sign are summed first; then each positive run either is a candidate or joins earlier ones.
    """
    positive = s > 0
    edge = np.flatnonzero(np.concatenate([[True], positive[1:] != positive[:-1]]))
    sums = np.add.reduceat(s, edge)
    ends = np.concatenate([edge[1:], [len(s)]])
    found: list[tuple[int, int, float, float]] = []  # (first, end, total before it, total to its end)
    rising: list[int] = []  # of ``found`` those with no later one that starts as low or lower; each is put in and taken out once
    before = 0.0
    for i, e, x in zip(edge.tolist(), ends.tolist(), sums.tolist(), strict=True):
        if x > 0:
            first, left, right = i, before, before + x
            while rising and found[rising[-1]][2] >= left:
                rising.pop()
            # the last one that starts lower is joined, with all between, unless it ends as high
            while rising and found[rising[-1]][3] < right:
                j = rising.pop()
                first, left = found[j][0], found[j][2]
                del found[j:]
            rising.append(len(found))
            found.append((first, e, left, right))
        before += x
    return [(i, e, r - b) for i, e, b, r in found]


def class_counts(sample: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``token, clean, toxic``: in how many of the sample's documents of either label each token stands; the same for beginnings, by tokens that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(2).to_numpy(zero_copy_only=False)
            for i, j, buf, bounds in slices(batch.column(1)):
                found = tokens(buf, bounds)
                h, at, which = found.distinct()
                doc = segment_ids(found.per)
                each = np.unique(which * np.int64(j - i) + doc) if len(h) else np.zeros(0, np.int64)
                one = label[i:j][each % max(j - i, 1)] == 1
                which = each // max(j - i, 1)
                counts = [np.bincount(which[m], minlength=len(h)) for m in (~one, one)]
                prefixes = found.prefixes(at).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array((np.arange(len(h) + 1) * len(PREFIXES)).astype(np.int32)), pa.array(prefixes.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), lists, pa.array(counts[0]), pa.array(counts[1])], ["token", "prefixes", "clean", "toxic"])

    rows = text_rows(sample, "label").mapInArrow(run, "token long, prefixes array<long>, clean long, toxic long")
    words = materialize(rows.groupBy("token").agg(F.first("prefixes").alias("prefixes"), F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "tokens")
    each = words.select(F.explode("prefixes").alias("token"), "clean", "toxic").filter("token <> 0")
    beginnings = each.groupBy("token").agg(F.count_if(F.col("clean") > 0).alias("clean"), F.count_if(F.col("toxic") > 0).alias("toxic"))
    return words.drop("prefixes"), beginnings


def corpus_counts(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """(count of each token or beginning of the vocabulary, tokens) over all documents, added up in each task before they are shuffled."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)  # tokens and beginnings that LEAST of the sample's documents have

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = known.value
        counts, n = np.zeros(len(keys) + 1, np.int64), 0
        for batch in batches:
            for _, _, buf, bounds in slices(batch.column(1)):
                found = tokens(buf, bounds)
                n += len(found.h)
                h, at, which = found.distinct()
                if not len(keys) or not len(h):
                    continue
                times = np.bincount(which, minlength=len(h))
                for part in (h, *found.prefixes(at).T):
                    i = np.minimum(np.searchsorted(keys, part), len(keys) - 1)
                    hit = keys[i] == part
                    counts[:-1] += np.bincount(i[hit], weights=times[hit], minlength=len(keys)).astype(np.int64)
        counts[-1] = n
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["i", "n"])

    got = text_rows(docs).mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(vocabulary) + 1, np.int64)
    counts[got["i"].to_numpy(int)] = got["n"].to_numpy(int)
    return counts[:-1], int(counts[-1])


def token_odds(clean: np.ndarray, toxic: np.ndarray, corpus: np.ndarray, total: int, n_clean: int, n_toxic: int) -> np.ndarray:
    """Log-odds of toxic over clean with the corpus's shares as prior, moved towards 0 by Z standard deviations."""
    prior = PRIOR * corpus / max(total, 1) + FLOOR
    weight = prior.sum() if len(prior) else 1.0
    a, b = toxic + prior, clean + prior
    odds = np.log(a / np.maximum(n_toxic + weight - a, FLOOR)) - np.log(b / np.maximum(n_clean + weight - b, FLOOR))
    doubt = np.sqrt(1 / a + 1 / b)
    return np.sign(odds) * np.maximum(np.abs(odds) - Z * doubt, 0)


def _solve_lambda(s: np.ndarray, weight: np.ndarray) -> float:
    """The positive root of E[e^(lambda s)] = 1, which exists if the mean is negative and some score is positive."""
    p = weight / weight.sum()
    mean = lambda x: float(np.log(np.maximum((p * np.exp(np.clip(x * s, -700, 700))).sum(), 1e-300)))
    low, high = 1e-6, 1.0
    while mean(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 0 else (low, mid)
    return max(high, 0.05)


def fit_odds(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> Odds:
    """The model; without labels of both kinds one that finds nothing toxic."""
    ship(docs.sparkSession)
    # of texts that the sample has more than once one counts, so that copies don't pass for evidence
    sample = labelled_sample(docs, labels, "toxic", limit).withColumn("_text", F.xxhash64("text")).dropDuplicates(["_text", "label"]).drop("_text")
    found = []
    for counted in class_counts(sample):
        both = F.col("clean") + F.col("toxic")
        table = counted.filter(both >= LEAST).orderBy("token").toPandas()
        sums = [int(x or 0) for x in counted.agg(F.sum("clean"), F.sum("toxic")).first()]
        found.append((table["token"].to_numpy(np.int64).view(np.uint64), table["clean"].to_numpy(float), table["toxic"].to_numpy(float), *sums))
    if not all(f[3] and f[4] for f in found) or not any(len(f[0]) for f in found):
        return Odds(np.zeros(0, np.uint64), np.zeros(0))
    keys = np.concatenate([f[0] for f in found])
    order = np.argsort(keys)
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys))
    corpus, total = corpus_counts(docs, keys[order])
    corpus = corpus[place]
    cut = len(found[0][0])
    scores = np.concatenate([token_odds(f[1], f[2], c, total, f[3], f[4]) for f, c in zip(found, (corpus[:cut], corpus[cut:]), strict=True)])
    scores = np.round(scores[order], 2)
    model = Odds(keys[order][scores != 0], scores[scores != 0], 0.0)
    values, weight = _clean_scores(sample, model)
    model.drift = DRIFT + max(0.0, float((values * weight).sum() / weight.sum()))
    model.lam = _solve_lambda(values - model.drift, weight)
    best, tokens_of, _, y = _training_evidence(sample, model, limit)
    # of clean documents' best scores: the mean of lambda x - log n is log K + Euler's constant
    usable = (y == 0) & (tokens_of > 0) & (best > 0)
    if usable.any():
        share = usable.sum() / max(((y == 0) & (tokens_of > 0)).sum(), 1)
        model.k = float(np.clip(share * np.exp(np.mean(model.lam * best[usable] - np.log(tokens_of[usable])) - np.euler_gamma), 1e-6, 1.0))
    _, _, evidence, y = _training_evidence(sample, model, limit)
    model.slope, model.at = _fit_curve(np.log1p(evidence), y)
    return model


def _clean_scores(sample: DataFrame, model: Odds) -> tuple[np.ndarray, np.ndarray]:
    """(score, tokens of clean text that have it); scores have two decimals, so there are few."""
    held = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, bounds in slices(batch.column(1)):
                v, n = np.unique(np.round(held.value.of(tokens(buf, bounds)) * 100), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)), pa.array(n)], ["v", "n"])

    got = text_rows(sample.filter("label = 0")).mapInArrow(run, "v long, n long").groupBy("v").agg(F.sum("n").alias("n")).toPandas()
    return got["v"].to_numpy(float) / 100, got["n"].to_numpy(float)


def _training_evidence(sample: DataFrame, model: Odds, limit: int):
    held = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, bounds in slices(batch.column(1)):
                found = tokens(buf, bounds)
                total, best, _ = held.value.evidence(held.value.of(found), found.per)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(best), pa.array(np.diff(found.per)), pa.array(total), batch.column(2)[i:j]], ["doc_id", "best", "n", "evidence", "label"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    got = text_rows(sample, "label").mapInArrow(run, f"doc_id {kind}, best double, n long, evidence double, label int").toPandas().sort_values("doc_id").head(limit)
    return tuple(got[c].to_numpy() for c in ("best", "n", "evidence", "label"))


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, middle) of a logistic curve with a ridge on both; the slope is positive."""
    w, b = 1.0, -1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w * x + b, -40, 40)))
        r = np.maximum(p * (1 - p), 1e-6)
        grad = np.array([((p - y) * x).sum() + 0.5 * (w - 1), (p - y).sum() + 0.01 * b])
        hess = np.array([[(r * x * x).sum() + 0.5, (r * x).sum()], [(r * x).sum(), r.sum() + 0.01]])
        step = np.linalg.solve(hess, grad)
        w, b = w - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    w = max(w, 0.1)
    return float(w), float(-b / w)


def score_toxicity(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """``docs(doc_id, text)``, ``labels(doc_id, toxic)`` -> doc_id, held_out, score, predicted, evidence, passages; a row per row of ``docs``.

    ``passages``: the significant segments as (start, end, score), in bytes of the UTF-8 text. Null and empty texts have no evidence and
    the least score. Rows that repeat are scored each, alike. Very long texts are scanned whole. Columns other than those named are not looked at. An empty table gives no rows.
    """
    model = fit_odds(docs, labels, limit)
    held = docs.sparkSession.sparkContext.broadcast(model)
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, bounds in slices(batch.column(1)):
                t = tokens(buf, bounds)
                total, _, found = held.value.evidence(held.value.of(t), t.per)
                starts, ends, per = t.starts, t.ends, t.per
                score = held.value.score(total)
                passages = [[{"start": int(starts[per[d] + a] - bounds[d]), "end": int(ends[per[d] + b - 1] - bounds[d]), "score": x} for a, b, x in parts] for d, parts in enumerate(found)]
                arrays = [batch.column(0)[i:j], batch.column(2)[i:j], pa.array(score), pa.array((score >= PREDICT_AT).astype(np.int32)), pa.array(total), pa.array(passages, spans)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "score", "predicted", "evidence", "passages"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return text_rows(docs, held_out().alias("held_out")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, evidence double, passages array<struct<start:long,end:long,score:double>>")
