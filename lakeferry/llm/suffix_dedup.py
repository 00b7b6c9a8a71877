"""Substring dedup over bytes, with suffix arrays.

A byte is removed if a string of LENGTH bytes that covers it also starts earlier, in a document of smaller id or farther ahead in
the same one. Runs of such strings whose anchor stands more than once (see ``anchors``) are dealt to shards by that anchor, so that equal strings share
a shard. A shard builds the suffix array of its bytes by
Larsson-Sadakane refinement (sort by eight bytes, then by the ranks found, doubling the depth, unsorted groups alone), gets
the common prefixes of neighbours in Kasai's way, and keeps the earliest of strings that have LENGTH bytes in common. An anchor that
very many documents have is dealt to several shards, whose sorted survivors are merged by binary search. A shard is a range of keys within
a task, which takes them up one after the other, so a task holds SHARD_BYTES, about, at a time. Every removal is a shard's or a merge's;
stretches that a shard has more than once, byte by byte, are one string of its suffix array.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeferry.llm.anchors import _BYTE, TAKE_BYTES, SpanHash, Windows, column_bytes_of, finish, flat_lists, repeated, run_lists, run_rows, stretches, unpack, whole_groups, with_rows
from lakeferry.llm.textcore import covered, mix, slices
from lakeferry.runtime import materialize, ship

LENGTH, GRAM = 100, 32
#: Bytes of a shard, about, unless one key's part has more.
SHARD_BYTES = 1 << 17
#: Runs whose bytes are sent in one batch.
TAKE_RUNS = 1 << 14


def suffix_array(buf: np.ndarray) -> np.ndarray:
    """Suffixes of ``buf`` in order (an end sorts first). They are sorted out fully, as the common prefixes rely on it.

    Larsson and Sadakane's refinement: ranks at depth h give the order at 2 h, and only groups of equal rank are sorted again.
    """
    n = len(buf)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    head = np.ndarray((n,), ">u8", padded, 0, (1,)).astype(np.uint64)
    order = np.argsort(head)
    new = np.ones(n, bool)
    new[1:] = head[order][1:] != head[order][:-1]
    first = np.flatnonzero(new)
    rank = np.zeros(n + 1, np.int64)
    rank[order] = np.repeat(first, np.diff(np.concatenate([first, [n]]))) + 1  # 0 is what lies behind the end
    h = 8
    while h < 2 * n:
        size = np.diff(np.concatenate([np.flatnonzero(new), [n]]))
        todo = np.flatnonzero(np.repeat(size > 1, size))
        if not len(todo):
            break
        s = order[todo]
        key = (rank[s].astype(np.uint64) << np.uint64(32)) | rank[np.minimum(s + h, n)].astype(np.uint64)
        by = np.argsort(key)
        order[todo], key = s[by], key[by]
        fresh = np.ones(len(todo), bool)
        fresh[1:] = key[1:] != key[:-1]
        new[todo] |= fresh
        first = np.flatnonzero(new)
        rank[order] = np.repeat(first, np.diff(np.concatenate([first, [n]]))) + 1
        h *= 2
    return order


def common_prefixes(buf: np.ndarray, order: np.ndarray, cap: int, stride: int = 8) -> np.ndarray:
    """Bytes, up to ``cap``, that each suffix has in common with its predecessor in ``order``.

    As Kasai: going from one text position to the next, at most one byte of the common prefix is lost, so the comparison goes on where it
    stood. Positions are gone through in ``stride`` waves, those of a wave together.
    """
    n = len(buf)
    padded = np.concatenate([buf, np.zeros(cap + 16, np.uint8)])
    lanes = np.ndarray((n + cap + 8,), "<u8", padded, 0, (1,))
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    plcp = np.zeros(n, np.int64)
    for wave in range(stride):
        i = np.arange(wave, n, stride)
        i = i[before[i] >= 0]
        k = before[i]
        length = np.maximum(plcp[i - 1] - 1, 0) if wave else np.zeros(len(i), np.int64)
        most = np.minimum(cap, n - np.maximum(i, k))
        live = np.flatnonzero(length < most)
        while len(live):
            at = length[live]
            x = lanes[i[live] + at] ^ lanes[k[live] + at]
            low = x & (~x + np.uint64(1))  # the lowest bit that differs
            step = np.where(x == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) >> 3)
            length[live] = at + step
            live = live[(x == 0) & (length[live] < most[live])]
        plcp[i] = np.minimum(length, most)
    return plcp[order]


def later_windows(buf: np.ndarray, sizes: np.ndarray, doc: np.ndarray, start: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One shard. Of stretches of ``sizes`` bytes, one after the other in ``buf``, that start at byte ``start`` of ``doc``: (doc, start, whether it stands earlier too, stretch, place in ``buf``) of every window."""
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    inner = np.arange(len(buf)) - begin[owner] if len(buf) else np.zeros(0, np.int64)
    window = inner <= sizes[owner] - length
    order = suffix_array(buf)
    prefix = common_prefixes(buf, order, length)
    group = np.cumsum(prefix < length)
    keep = window[order]
    at, group = order[keep], group[keep]
    d, s = doc[owner[at]], start[owner[at]] + inner[at]
    by = np.lexsort((s, d, group))
    at, group, d, s = at[by], group[by], d[by], s[by]
    head = np.ones(len(at), bool)
    head[1:] = group[1:] != group[:-1]
    lead = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0)) if len(at) else np.zeros(0, np.int64)
    later = (d != d[lead]) | (s != s[lead])
    return d, s, later, owner[at], at


def merge_sorted(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of windows that stand earlier in another shard. ``parts``: sorted digests (of two words, high and low), doc, start of each shard's survivors."""
    digest, doc, start = parts[0]
    gone_d, gone_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, d, s in parts[1:]:
        at = np.minimum(np.searchsorted(digest, k), max(len(digest) - 1, 0))
        hit = digest[at] == k if len(digest) else np.zeros(len(k), bool)
        i, j = at[hit], np.flatnonzero(hit)
        less = (d[j] < doc[i]) | ((d[j] == doc[i]) & (s[j] < start[i]))
        equal = (d[j] == doc[i]) & (s[j] == start[i])
        gone_d += [doc[i[less]], d[j[~less & ~equal]]]
        gone_s += [start[i[less]], s[j[~less & ~equal]]]
        doc, start = doc.copy(), start.copy()
        doc[i[less]], start[i[less]] = d[j[less]], s[j[less]]
        new = np.searchsorted(digest, k[~hit])
        digest, doc, start = np.insert(digest, new, k[~hit]), np.insert(doc, new, d[~hit]), np.insert(start, new, s[~hit])
    return np.concatenate(gone_d), np.concatenate(gone_s)


def sorted_digests(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(digests of 16 bytes that numpy can sort and search, their order)"""
    both = np.ascontiguousarray(np.column_stack([high, low]).astype(np.int64).view(np.uint64).astype(">u8")).view("S16").ravel()
    order = np.argsort(both, kind="stable")
    return both[order], order


def repeated_strings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc, start, n: strings of ``length`` bytes of ``docs(doc_id, text)`` that start earlier too, as stretches of n starts from ``start`` on."""
    spec = Windows(length, min(GRAM, max(1, length // 3)), False)
    runs = repeated(run_rows(docs, spec))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            at, (pos, key, part) = flat_lists(batch, [2, 3, 4])
            for i, j, buf, bounds in slices(batch.column(1), TAKE_BYTES):
                row = np.repeat(np.arange(j - i), np.diff(at[i : j + 1]))
                for a in range(0, len(row), TAKE_RUNS):
                    own = slice(at[i] + a, min(at[i] + a + TAKE_RUNS, at[j]))
                    yield _contents(buf, bounds, ids[i:j], row[a : a + TAKE_RUNS], pos[own], key[own], part[own], length)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, lambda b: len(column_bytes_of(b.column(4))[0]), SHARD_BYTES):
            yield judge_shard(table, length)

    dealt = with_rows(docs, runs, "pos", "key", "part").mapInArrow(cut, "key long, part long, doc long, start long, content binary")
    dealt = dealt.repartition("key", "part").sortWithinPartitions("key", "part")
    judged = materialize(dealt.mapInArrow(judge, "doc long, start long, n long, key long, part long, high long, low long"), "judged")

    def merge(table: pa.Table) -> pa.Table:
        part, high, low, doc, start = (table.column(c).to_numpy() for c in ("part", "high", "low", "doc", "start"))
        parts = []
        for x in np.unique(part):
            at = np.flatnonzero(part == x)
            digest, order = sorted_digests(high[at], low[at])
            parts.append((digest, doc[at][order], start[at][order]))
        d, s = merge_sorted(parts)
        return pa.table({"doc": d, "start": s, "n": np.ones(len(d), np.int64)})

    # survivors of an anchor that several shards have meet by key and range of digests: as many ranges as shards
    across = judged.filter("part >= 0").withColumn("range", F.pmod("high", F.shiftright("part", 32))).select("doc", "start", "key", "range", "part", "high", "low")
    across = across.groupBy("key", "range").applyInArrow(merge, "doc long, start long, n long")
    return judged.filter("part < 0").select("doc", "start", "n").unionByName(across)


def _contents(buf: np.ndarray, bounds: np.ndarray, ids: np.ndarray, row: np.ndarray, pos: np.ndarray, key: np.ndarray, part: np.ndarray, length: int) -> pa.RecordBatch:
    """key, part, doc, start, content of runs; ``row``: the document of each."""
    start, _, n = unpack(pos)
    size = n + (length - 1)
    fits = start + size <= np.diff(bounds)[row]  # not so only where rows of one id have unlike texts
    row, start, size, key, part = row[fits], start[fits], size[fits], key[fits], part[fits]
    offsets = np.concatenate([[0], np.cumsum(size)])
    content = buf[np.repeat(start + bounds[row] - offsets[:-1], size) + np.arange(offsets[-1])]
    binary = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(content)])
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(part), pa.array(ids[row]), pa.array(start), binary], ["key", "part", "doc", "start", "content"])


def equal_stretches(buf: np.ndarray, bounds: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each stretch the earliest one that has the same bytes, itself or another."""
    size, digest = np.diff(bounds), SpanHash(_BYTE[buf])(bounds[:-1], bounds[1:])
    order = np.lexsort((start, doc, digest, size))
    new = np.ones(len(order), bool)
    new[1:] = (size[order][1:] != size[order][:-1]) | (digest[order][1:] != digest[order][:-1])
    first = np.empty(len(order), np.int64)
    first[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
    # the hash only says which to compare
    copy = np.flatnonzero(first != np.arange(len(first)))
    offsets = np.concatenate([[0], np.cumsum(size[copy])])
    inner = np.arange(offsets[-1]) - np.repeat(offsets[:-1], size[copy])
    same = buf[np.repeat(bounds[:-1][copy], size[copy]) + inner] == buf[np.repeat(bounds[:-1][first[copy]], size[copy]) + inner]
    unlike = copy[np.add.reduceat(~same, offsets[:-1]) > 0] if len(copy) else copy
    first[unlike] = unlike
    return first


def judge_shard(table: pa.Table, length: int = LENGTH) -> pa.RecordBatch:
    """A shard's removed windows as stretches, with part -1; of keys in parts also the survivors, with digests. ``table``: key, part, doc, start, content.

    Stretches that are equal byte by byte are one string of the suffix array, the earliest; all windows of the others are later ones.
    """
    key, part, doc, start = (table.column(c).to_numpy() for c in range(4))
    buf, bounds = column_bytes_of(table.column(4))
    size, first = np.diff(bounds), equal_stretches(buf, bounds, doc, start)
    own = first == np.arange(len(first))
    copies = ~own & ((doc != doc[first]) | (start != start[first]))
    buf, gone = buf[np.repeat(own, size)], (doc[copies], start[copies], size[copies] - (length - 1))
    key, part, doc, start, size = key[own], part[own], doc[own], start[own], size[own]
    d, s, later, owner, at = later_windows(buf, size, doc, start, length)
    gd, gs, gn = (np.concatenate(x) for x in zip(stretches(d[later], s[later]), gone, strict=True))
    zero = np.zeros(len(gd), np.int64)
    tell = np.flatnonzero(~later & (part[owner] >= 0)) if len(at) else np.zeros(0, np.int64)
    cols = [gd, gs, gn, zero, zero - 1, zero, zero]
    if len(tell):
        high, low = (SpanHash(v)(at[tell], at[tell] + length).view(np.int64) for v in (_BYTE[buf], mix(_BYTE[buf] ^ np.uint64(0xC2B2AE3D27D4EB4F))))
        more = [d[tell], s[tell], np.ones(len(tell), np.int64), key[owner[tell]], part[owner[tell]], high, low]
        cols = [np.concatenate(x) for x in zip(cols, more, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["doc", "start", "n", "key", "part", "high", "low"])


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans; a row per row of ``docs``. doc_id must be a whole number.

    ``spans``: the removed stretches, as (start, end) in bytes. Null texts are empty; they, and texts shorter than ``length``, lose nothing. Rows
    that repeat a doc_id with its text are one document (of rows with one id and unlike texts, strings at one place count as one); a row without a doc_id loses nothing and makes no other lose anything. Very long texts are taken whole, in pieces. An empty table gives no rows.
    Columns other than the two named are not looked at.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    removed = materialize(repeated_strings(docs, length), "strings")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        buf, bounds = column_bytes_of(batch.column(1))
        gone, spans, sha, where = [], [], [], []
        for d, (start, count) in enumerate(zip(run_lists(batch.column(2)), run_lists(batch.column(3)), strict=True)):
            own = buf[bounds[d] : bounds[d + 1]]
            if not len(start):
                gone.append(0), spans.append(0), where.append([])
                sha.append(hashlib.sha256(own.tobytes()).hexdigest())
                continue
            mask = np.concatenate([[False], covered(start, count + (length - 1), len(own)), [False]])
            turn = np.flatnonzero(mask[1:] != mask[:-1])
            gone.append(int(mask.sum()))
            spans.append(len(turn) // 2)
            where.append([{"start": int(a), "end": int(b)} for a, b in turn.reshape(-1, 2)])
            sha.append(hashlib.sha256(own[~mask[1:-1]].tobytes()).hexdigest())
        cols = [batch.column(0), pa.array(np.diff(bounds)), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), pa.array(where, kind)]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return finish(docs, removed, judge, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")
