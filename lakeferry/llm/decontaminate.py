"""Benchmark decontamination by SimHash of item-sized windows.

Windows have an item's number of words (or all of a shorter document's) and any start. The weighted Jaccard similarity of the two bags of shingles, sum of lesser over sum
of greater counts, must be SIMILARITY or more. A bag is taken as the set of its (shingle, occurrence number) pairs, whose set similarity is the same, so that
shingles that repeat count as often as they stand; its fingerprint has BITS bits, each the majority of a bit of the pairs' hashes.

1. A window that has too few shingles of any item to reach SIMILARITY is left out, by one running sum for each length of items. All others are fingerprinted,
   by running sums of the pairs' bits.
2. A table of BLOCKS blocks finds all items of that length whose fingerprints differ in RADIUS bits at most: two such agree in some block up to RADIUS // BLOCKS bits.
3. Of each pair found, the exact similarity of the windows of all starts is taken, and the best one is returned.

Sets alike at 0.8 differ in 39 of 256 bits on average, with a standard deviation of 6, so RADIUS is 7 deviations off: one pair in some 10**11 is lost, fewer above 0.8.

Items come in blocks of up to ITEM_WORDS words, so what is sent to executors is bounded; each block is a pass over the documents, and only
one is held at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeferry.llm.docstats import text_rows
from lakeferry.llm.textcore import mix, shingle_hashes, slices, word_hashes
from lakeferry.runtime import materialize, ship

WORDS, SIMILARITY = 5, 0.8
BITS, BLOCKS, RADIUS = 256, 16, 79
#: Words of the benchmark items that are looked for in one pass.
ITEM_WORDS = 1 << 20

_WIDTH = BITS // BLOCKS
#: Every way to change up to RADIUS // BLOCKS bits of a block.
_NEAR = np.array([sum(1 << b for b in bits) for k in range(RADIUS // BLOCKS + 1) for bits in combinations(range(_WIDTH), k)], np.uint16)
_LANES = np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def pair_bits(shingles: np.ndarray, number: np.ndarray) -> np.ndarray:
    """(pairs, BITS) of 0 and 1: the hash of each (shingle, occurrence number from 0)."""
    pair = mix(shingles + (number.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    return np.unpackbits(mix(pair[:, None] ^ _LANES).view(np.uint8), axis=1)


def occurrence(shingles: np.ndarray) -> np.ndarray:
    """How many equal ones stand before each."""
    order = np.argsort(shingles, kind="stable")
    x = shingles[order]
    new = np.concatenate([[True], x[1:] != x[:-1]])[: len(x)]
    out = np.empty(len(x), np.int64)
    out[order] = np.arange(len(x)) - np.maximum.accumulate(np.where(new, np.arange(len(x)), 0)) if len(x) else out
    return out


def blocks_of(sums: np.ndarray, n: int) -> np.ndarray:
    """(fingerprints, BLOCKS) from the sums of n pairs' bits."""
    return np.packbits(2 * sums > n, axis=-1).view(">u2").astype(np.uint16)


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    """The blocks of a bag's SimHash."""
    return blocks_of(pair_bits(shingles, occurrence(shingles)).sum(axis=0, dtype=np.int64)[None], len(shingles))[0]


def window_prints(shingles: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The fingerprints of the windows of ``size`` shingles at ``starts``, which are in order.

    Running sums take each shingle as the first of its kind. In windows that also hold j earlier equal ones it is the one after them; what that changes is
    added to all starts up to the j-th before it.
    """
    low, high = int(starts[0]), int(starts[-1]) + size
    own = shingles[low:high]
    sums = np.zeros((len(own) + 1, BITS), np.int32)
    np.cumsum(pair_bits(own, np.zeros(len(own), np.int64)), axis=0, dtype=np.int32, out=sums[1:])
    at = starts - low
    out = sums[at + size] - sums[at]
    order = np.argsort(own, kind="stable")
    x = own[order]
    j = 1
    while j < size:
        later, earlier = order[j:], order[:-j]
        near = (x[j:] == x[:-j]) & (later - earlier < size)
        if not near.any():
            break
        later, earlier = later[near], earlier[near]
        change = pair_bits(own[later], np.full(len(later), j)).astype(np.int32) - pair_bits(own[later], np.full(len(later), j - 1))
        edge = np.zeros((len(own) + 1, BITS), np.int32)
        np.add.at(edge, np.maximum(later - size + 1, 0), change)
        np.subtract.at(edge, earlier + 1, change)
        out += np.cumsum(edge, axis=0)[at]
        j += 1
    return blocks_of(out, size)


class Prints:
    """Fingerprints in a table for each block."""

    def __init__(self, blocks: np.ndarray):
        self.blocks = blocks.reshape(-1, BLOCKS)
        self.order = np.argsort(self.blocks, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.blocks, self.order, axis=0)

    def within(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, fingerprint) whose bits differ in RADIUS places at most."""
        found = [np.zeros(0, np.int64)]
        for b in range(BLOCKS):
            if len(self.blocks) <= len(_NEAR):
                # fewer entries than values near one: each entry is looked at
                w, i = np.nonzero(np.bitwise_count(windows[:, b, None] ^ self.blocks[None, :, b]) <= RADIUS // BLOCKS)
                found.append(w * len(self.blocks) + i)
                continue
            for w, near in enumerate(windows[:, b, None] ^ _NEAR):
                low, high = np.searchsorted(self.sorted[:, b], near, "left"), np.searchsorted(self.sorted[:, b], near, "right")
                found += [w * len(self.blocks) + self.order[x:y, b] for x, y in zip(low[high > low], high[high > low], strict=True)]
        w, i = np.divmod(np.unique(np.concatenate(found)), len(self.blocks))
        near = np.bitwise_count(windows[w] ^ self.blocks[i]).sum(axis=1) <= RADIUS
        return w[near], i[near]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags of shingles."""
    keys, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(at[: len(a)], minlength=len(keys)), np.bincount(at[len(a) :], minlength=len(keys))
    most = np.maximum(x, y).sum()
    return float(np.minimum(x, y).sum() / most) if most else 0.0


class Items:
    """Benchmark items with their shingles."""

    def __init__(self, ids: list, texts: list[str | None]):
        column = pa.array([(t or "").encode("utf-8", "replace") for t in texts], pa.binary())
        self.ids, self.bags, self.words = [], [], []
        for i, j, buf, bounds in slices(column):
            h, per = word_hashes(buf, bounds, lower=True)
            s, at = shingle_hashes(h, per, WORDS)
            for k in range(j - i):
                if at[k + 1] > at[k]:
                    self.ids.append(ids[i + k])
                    self.bags.append(s[at[k] : at[k + 1]])
                    self.words.append(int(per[k + 1] - per[k]))
        self.n_words, self.n_shingles = np.array(self.words, np.int64), np.array([len(b) for b in self.bags], np.int64)
        # the shingles of all items, and how often one has them at most; the items of each length
        grams = np.concatenate([np.zeros(0, np.uint64), *self.bags])
        often = np.concatenate([np.zeros(0, np.int64), *[occurrence(b) + 1 for b in self.bags]])
        order = np.lexsort((often, grams))
        last = np.concatenate([grams[order][1:] != grams[order][:-1], [True]])[: len(grams)]
        self.grams, self.most = grams[order][last], often[order][last]
        self.lengths = np.unique(self.n_words)
        self.of_length = {int(n): np.flatnonzero(self.n_words == n) for n in self.lengths}
        self.prints = np.array([fingerprint(b) for b in self.bags]).reshape(-1, BLOCKS)
        self.tables = {n: Prints(self.prints[k]) for n, k in self.of_length.items()}

    def search(self, h: np.ndarray, shingles: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """item -> (similarity, first word, words) of the window most like it, the first of equals. ``h``: the document's word hashes."""
        if not len(self.grams) or not len(shingles):
            return {}
        entry = np.minimum(np.searchsorted(self.grams, shingles), len(self.grams) - 1)
        place = np.flatnonzero(self.grams[entry] == shingles)
        if not len(place):
            return {}
        # of a shingle that items have c times at most, an occurrence counts in the windows that hold it and fewer than c before it
        order = np.lexsort((place, entry[place]))
        place = place[order]
        kind = entry[place]
        back = np.arange(len(place)) - self.most[kind]
        after = np.where(back >= np.searchsorted(kind, kind, "left"), place[np.maximum(back, 0)] + 1, 0)
        hit: set[int] = set()
        # windows of the whole document, of items at least as long, then of each shorter length
        for n in [*self.lengths[self.lengths < len(h)].tolist(), *self.lengths[self.lengths >= len(h)].tolist()]:
            items, size = self.of_length[n], min(max(min(n, len(h)) - WORDS + 1, 1), len(shingles))
            need = SIMILARITY * (size + int(self.n_shingles[items].min())) / (1 + SIMILARITY) - 1e-6
            if len(place) < need:
                continue
            begin = np.maximum(place - size + 1, after)
            held = np.bincount(np.maximum(begin, 0), minlength=len(shingles) + 1) - np.bincount(np.maximum(place + 1, begin), minlength=len(shingles) + 1)
            starts = np.flatnonzero(np.cumsum(held)[: len(shingles) - size + 1] >= need)
            for part in np.split(starts, np.flatnonzero(np.diff(starts) > size) + 1):
                if len(part):
                    hit.update(items[self.tables[n].within(window_prints(shingles, part, size))[1]].tolist())
        found = {k: self.verify(k, h, shingles) for k in hit}
        return {k: v for k, v in found.items() if v[0] >= SIMILARITY}

    def verify(self, k: int, h: np.ndarray, shingles: np.ndarray) -> tuple[float, int, int]:
        """(similarity, first word, words) of the window most like item ``k``, of all starts, exactly: the starts at which an occurrence counts are an interval."""
        grams, count = np.unique(self.bags[k], return_counts=True)
        entry = np.minimum(np.searchsorted(grams, shingles), len(grams) - 1)
        place = np.flatnonzero(grams[entry] == shingles)
        words = min(self.words[k], len(h))
        size = min(max(words - WORDS + 1, 1), len(shingles))
        order = np.lexsort((place, entry[place]))
        place = place[order]
        kind = entry[place]
        back = np.arange(len(place)) - count[kind]
        begin = np.maximum(place - size + 1, np.where(back >= np.searchsorted(kind, kind, "left"), place[np.maximum(back, 0)] + 1, 0))
        change = np.bincount(np.maximum(begin, 0), minlength=len(shingles) + 1) - np.bincount(np.maximum(place + 1, begin), minlength=len(shingles) + 1)
        overlap = np.cumsum(change)[: len(shingles) - size + 1]
        start = int(np.argmax(overlap))
        both = int(overlap[start])
        return both / (size + int(self.n_shingles[k]) - both), start, words


def item_blocks(benchmark: DataFrame) -> Iterator[tuple[Items, bool]]:
    """The items in blocks whose words are bounded, each with whether there are several; null and empty items match nothing. An item alone may exceed the bound."""
    words = F.size(F.split(F.trim(F.coalesce("text", F.lit(""))), "[ \t-\r]+"))
    total = benchmark.agg(F.sum(words)).first()[0] or 0
    blocks = int(total // ITEM_WORDS) + 1
    for b in range(blocks):
        rows = benchmark.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else benchmark
        got = rows.select(F.col("item_id").cast("string").alias("item_id"), "text").distinct().orderBy("item_id", "text").collect()  # ITEM_WORDS words, about
        yield Items([r[0] for r in got], [r[1] for r in got]), blocks > 1


def _searches(batch: pa.RecordBatch, column: int, items: Items) -> Iterator[tuple[int, dict]]:
    for i, j, buf, bounds in slices(batch.column(column)):
        h, per = word_hashes(buf, bounds, lower=True)
        s, at = shingle_hashes(h, per, WORDS)
        known = np.searchsorted(items.grams, s) if len(items.grams) else np.zeros(0, np.int64)
        hit = np.flatnonzero(items.grams[np.minimum(known, len(items.grams) - 1)] == s) if len(known) else known
        for k in np.unique(np.searchsorted(at, hit, "right") - 1).tolist():
            yield i + k, items.search(h[per[k] : per[k + 1]], s[at[k] : at[k + 1]])


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs(doc_id, text)``, ``benchmark(item_id, text)`` -> doc_id, item_id, similarity, first_word, n_words: of each pair the window most like the item.

    Letters A-Z count as a-z. An item or document of fewer than five words has its whole sequence as one shingle. Null and empty texts and items
    match nothing. Rows that repeat give their pairs again; rows of one item_id and unlike texts are items of their own. Very long texts are searched whole. Empty tables
    give no rows. Of windows equally like an item the first is returned. Columns other than the two named are not looked at.
    """
    ship(docs.sparkSession)
    kind, item = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType
    parts = []
    for items, more in item_blocks(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(items)  # ITEM_WORDS words

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(r, held.value.ids[k], *v) for r, best in _searches(batch, 1, held.value) for k, v in sorted(best.items())]
                cols = [batch.column(0).take(pa.array([f[0] for f in found], pa.int64())), *[pa.array([f[c] for f in found], t) for c, t in ((1, pa.string()), (2, pa.float64()), (3, pa.int64()), (4, pa.int64()))]]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "similarity", "first_word", "n_words"])

        part = text_rows(docs).mapInArrow(run, f"doc_id {kind}, item_id string, similarity double, first_word long, n_words long")
        if more:
            part = materialize(part, "leaks")
            held.destroy()
        parts.append(part)
    return reduce(DataFrame.unionByName, parts).withColumn("item_id", F.col("item_id").cast(item))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any leaked item, with all their columns, whatever these are called; nothing is shuffled.

    Null and empty texts stay, as do rows without an id; rows that repeat stay or go alike. Empty tables give no rows, or all.
    """
    ship(docs.sparkSession)
    names = docs.columns
    at = next(i for i, c in enumerate(names) if c == "text")
    for items, more in item_blocks(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[r for r, best in _searches(batch, at, held.value) if best]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
        if more:
            docs = materialize(docs, "clean")
            held.destroy()
    return docs
