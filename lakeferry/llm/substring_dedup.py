"""Substring dedup over words, by level-wise doubling.

A window is WINDOW consecutive words of a document. A word is removed if a window that covers it stands anywhere else too. A
window can only be repeated if the shorter windows in it are, so lengths are gone through from short to long, about doubling, and
only what is repeated at one length is extended to the next: the least 9-word window in each window, then about 18 words to its
left or right, then the window itself. At each level what stands once is dropped; no level settles anything but by its own length.

Windows of the last level are told by two 64-bit hashes, of the 18 words and of all 35.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeferry.llm.anchors import TAKE_BYTES, SpanHash, Windows, column_bytes_of, finish, flat_lists, halves, pack, repeated, run_lists, run_rows, stretches, unpack, whole_groups, with_rows
from lakeferry.llm.textcore import covered, mix, run_hashes, slices, word_hashes
from lakeferry.runtime import materialize, ship

WINDOW = 35
#: Windows that a worker compares at a time, about, unless one key's part has more.
GROUP_WINDOWS = 1 << 18


def levels(window: int) -> list[int]:
    """The lengths gone through: halved from ``window`` down to where a length has little to tell."""
    out = [window]
    while out[0] > 12:
        out.insert(0, -(-out[0] // 2))
    return out


def _word_runs(batch: pa.RecordBatch, spec: Windows, columns: list[int]) -> Iterator[tuple]:
    """(ids, word hashes, first word of each document, document of each run, the columns' values by run) for some texts at a time."""
    ids = batch.column(0).to_numpy()
    at, values = flat_lists(batch, columns)
    for i, j, buf, bounds in slices(batch.column(1), TAKE_BYTES):
        h, per = word_hashes(buf, bounds)
        row = np.repeat(np.arange(j - i), np.diff(at[i : j + 1]))
        own = [v[at[i] : at[j]] for v in values]
        start, _, n = unpack(own[0])
        fits = start + n + (spec.length - 1) <= np.diff(per)[row]  # not so only where rows of one id have unlike texts
        yield ids[i:j], h, per, row[fits], [v[fits] for v in own]


def extended(docs: DataFrame, rows: DataFrame, spec: Windows) -> DataFrame:
    """key, doc, pos: the halves of runs(doc, pos), with the hash of the words that all windows of a half hold."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, h, per, row, (pos,) in _word_runs(batch, spec, [2]):
                start, offset, n = unpack(pos)
                span = SpanHash(h)
                for side, (which, first, m, low, high) in enumerate(halves(spec, start + per[row], offset, n)):
                    key = mix(span(low, high) + np.uint64(side))
                    at = pack(first - per[row[which]], np.zeros(len(which), np.int64), m)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[row[which]]), pa.array(at)], ["key", "doc", "pos"])

    return with_rows(docs, rows, "pos").mapInArrow(extend, "key long, doc long, pos long")


def _whole(docs: DataFrame, rows: DataFrame, spec: Windows) -> DataFrame:
    """key, part, doc, start, windows: halves(key, part, doc, pos) with the hashes of their windows, 8 bytes each."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, h, per, row, (pos, key, part) in _word_runs(batch, spec, [2, 3, 4]):
                start, _, n = unpack(pos)
                offsets = np.concatenate([[0], np.cumsum(n)])
                at = np.repeat(start + per[row] - offsets[:-1], n) + np.arange(offsets[-1])
                found = np.ascontiguousarray(run_hashes(h, spec.length)[at] if len(at) else np.zeros(0, np.uint64))
                windows = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((8 * offsets).astype(np.int32)), pa.py_buffer(found)])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part), pa.array(ids[row]), pa.array(start), windows], ["key", "part", "doc", "start", "windows"])

    return with_rows(docs, rows, "pos", "key", "part").mapInArrow(hashes, "key long, part long, doc long, start long, windows binary")


def compare(key: np.ndarray, part: np.ndarray, doc: np.ndarray, start: np.ndarray, windows: list[np.ndarray]) -> pa.RecordBatch:
    """Windows of whole parts of keys: those that stand at two places, as stretches(doc, start, n). Of keys in parts also each different window once,
    with n 1 if it stands twice in the part, else 0, and its hash."""
    n = np.array([len(w) for w in windows], np.int64)
    of = np.repeat(np.arange(len(key)), n)
    window = np.concatenate([np.zeros(0, np.uint64), *windows])
    k, d = key[of], doc[of]
    s = start[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    order = np.lexsort((s, d, window, k))
    k, d, s, window, of = k[order], d[order], s[order], window[order], of[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (window[1:] != window[:-1])
    # a group's first and last row differ if it stands at two places
    head = np.flatnonzero(new)
    tail = np.concatenate([head[1:], [len(k)]]) - 1 if len(head) else head
    twice = (d[head] != d[tail]) | (s[head] != s[tail])
    all_ = np.repeat(twice, tail - head + 1)
    gd, gs, gn = stretches(d[all_], s[all_])
    tell = head[part[of[head]] >= 0]
    seen = twice[part[of[head]] >= 0].astype(np.int64)
    zero = np.zeros(len(gd), np.int64)
    cols = [(gd, d[tell]), (gs, s[tell]), (gn, seen), (zero, k[tell]), (zero, window[tell].view(np.int64)), (zero, np.ones(len(tell), np.int64))]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in cols], ["doc", "start", "n", "key", "window", "across"])


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc, start, n: every repeated window of ``docs(doc_id, text)``, as stretches of n windows from word ``start`` on."""
    spec = Windows(window, levels(window)[0], True)
    halved = materialize(extended(docs, repeated(run_rows(docs, spec)), spec), "halves", plain=True)
    rows = _whole(docs, repeated(halved), spec)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, lambda b: len(column_bytes_of(b.column(4))[0]) // 8, GROUP_WINDOWS):
            key, part, doc, start = (table.column(c).to_numpy() for c in range(4))
            buf, at = column_bytes_of(table.column(4))
            windows = np.ascontiguousarray(buf).view(np.uint64)
            yield compare(key, part, doc, start, [windows[a:b] for a, b in zip(at[:-1] // 8, at[1:] // 8, strict=True)])

    rows = rows.repartition("key", "part").sortWithinPartitions("key", "part")
    judged = materialize(rows.mapInArrow(judge, "doc long, start long, n long, key long, window long, across long"), "judged", plain=True)
    # windows of keys in parts that stand once in theirs, but in other parts too
    across = judged.filter("across = 1")
    known = across.groupBy("key", "window").agg(F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    other = across.filter("n = 0").join(known, ["key", "window"]).select("doc", "start", F.lit(1).cast("long").alias("n"))
    return judged.filter("across = 0").select("doc", "start", "n").unionByName(other)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, n_words, n_removed, kept_sha256, kept; a row per row of ``docs``. doc_id must be a whole number.

    ``kept``: the words left, joined by one space. Null or empty texts have no words, and the hash of nothing. Rows that repeat a
    doc_id with its text are one document, whose windows are at one place (of rows with one id and unlike texts, windows at one place count as one);
    a row without a doc_id loses nothing and makes no other
    lose anything. Very long texts are taken whole. An empty table
    gives no rows. Columns other than the two named are not looked at.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    removed = repeated_windows(docs, window)

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, gone, sha, kept = [], [], [], []
        for text, start, count in zip(batch.column(1), run_lists(batch.column(2)), run_lists(batch.column(3)), strict=True):
            words = text.as_py().split()
            mask = covered(start, count + (window - 1), len(words)) if len(start) else np.zeros(len(words), bool)
            left = b" ".join(compress(words, (~mask).tolist()) if len(start) else words)
            n.append(len(words))
            gone.append(int(mask.sum()))
            sha.append(hashlib.sha256(left).hexdigest())
            kept.append(left)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return finish(docs, removed, judge, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
