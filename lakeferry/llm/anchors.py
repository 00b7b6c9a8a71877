"""Exact search for repeated windows of fixed length over a whole corpus, without shuffling every window.

Every window of W units (bytes, or words) has one anchor, the least of the k-unit grams that it holds; equal windows have
equal anchors at equal places. Consecutive windows of one anchor are a run, whose key is the anchor. Only runs whose key stands more
than once are looked at further. Keys are counted by a grouping, which adds up before it shuffles, and rows meet their key's count by a join, or by a
broadcast of the commonest keys' counts. Rows of one key that many documents have are then dealt to parts of about
``KEY_ROWS``, so that no task gathers a key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeferry.llm.docstats import text_rows
from lakeferry.llm.textcore import column_bytes, minimizers, mix, run_hashes, slices, word_hashes
from lakeferry.runtime import materialize

_U = np.uint64
_M = _U(0xD1342543DE82EF95)
_M_INV = _U(pow(int(_M), -1, 1 << 64))
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
#: Bytes of a document that are looked at in one piece; windows that cross pieces belong to the first.
PIECE_BYTES = 1 << 20
#: Rows of one key that one task compares, about; a key of more rows is dealt to parts.
KEY_ROWS = 2048
#: Keys whose counts are broadcast at most, 16 bytes each.
HOT_KEYS = 1 << 16
#: A filter has FILTER_SPARE bits for each document in it, from FILTER_LEAST up to FILTER_MOST; for more documents none is made.
FILTER_LEAST, FILTER_MOST, FILTER_SPARE = 1 << 16, 1 << 26, 16
#: Bytes of text, and rows, that a worker has in hand at a time.
TAKE_BYTES = 1 << 17


@dataclass(frozen=True)
class Windows:
    """``length`` units a window, up to 4095, ``gram`` units an anchor; ``words``: units are words, else bytes."""

    length: int
    gram: int
    words: bool

    @property
    def reach(self) -> int:
        """Grams of a window."""
        return self.length - self.gram + 1

    @property
    def half(self) -> int:
        """Windows that start up to this far before the anchor are right halves."""
        return self.reach // 2


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class SpanHash:
    """Hashes of any stretches of a unit array, by prefix sums of a polynomial."""

    _up = _down = np.zeros(0, np.uint64)

    def __init__(self, values: np.ndarray):
        n = len(values) + 1
        if len(SpanHash._up) < n:
            SpanHash._up, SpanHash._down = _powers(2 * n, _M), _powers(2 * n, _M_INV)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(values * SpanHash._up[: n - 1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * SpanHash._down[start] + (end - start).astype(np.uint64))


def unit_pieces(column: pa.Array, spec: Windows) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(unit values, first unit of each stretch and one more, row of each stretch, first unit of the stretch in its document)."""
    for i, j, buf, bounds in slices(column, TAKE_BYTES):
        if spec.words:
            h, per = word_hashes(buf, bounds)
            yield h, per, np.arange(i, j), np.zeros(j - i, np.int64)
        elif len(buf) <= PIECE_BYTES:
            yield _BYTE[buf], bounds, np.arange(i, j), np.zeros(j - i, np.int64)
        else:
            for at in range(0, max(1, len(buf) - spec.length + 1), PIECE_BYTES):
                part = buf[at : at + PIECE_BYTES + spec.length - 1]
                yield _BYTE[part], np.array([0, len(part)]), np.array([i]), np.array([at])


def find_runs(values: np.ndarray, per: np.ndarray, spec: Windows) -> tuple[np.ndarray, ...]:
    """(stretch, anchor's unit, first window, windows, anchor's hash) of every run."""
    none = np.zeros(0, np.int64)
    starts = len(values) - spec.length + 1
    if starts <= 0:
        return none, none, none, none, none.view(np.uint64)
    grams = run_hashes(values, spec.gram)
    anchor = minimizers(grams, spec.reach)
    owner = np.repeat(np.arange(len(per) - 1), np.diff(per))
    valid = owner[:starts] == owner[spec.length - 1 :]
    new = np.ones(starts, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    # a run ends before the next one, or where windows stop being valid
    stop = np.flatnonzero(np.concatenate([(new | ~valid)[1:], [True]])) + 1
    n = stop[np.searchsorted(stop, first, "right")] - first
    return owner[first], anchor[first], first, n, grams[anchor[first]]


def pack(start: np.ndarray, offset: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (start << 24) | (offset << 12) | n


def unpack(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, anchor's distance from it, windows)"""
    return pos >> 24, (pos >> 12) & 4095, pos & 4095


def run_rows(docs: DataFrame, spec: Windows) -> DataFrame:
    """key, doc, pos of every run of ``docs(doc_id, text)``. Rows without a doc_id don't count."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for values, per, row, base in unit_pieces(batch.column(1), spec):
                stretch, a, s, n, g = find_runs(values, per, spec)
                pos = pack(s - per[stretch] + base[stretch], a - s, n)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(ids[row[stretch]]), pa.array(pos)], ["key", "doc", "pos"])

    return text_rows(docs.filter("doc_id IS NOT NULL")).mapInArrow(read, "key long, doc long, pos long")


def repeated(rows: DataFrame) -> DataFrame:
    """Those of rows(key, doc, pos) whose key stands more than once, with ``part``: -1, or of keys of more than KEY_ROWS rows the part that the row is dealt to, behind
    the number of parts (its upper 32 bits).

    The counts of the HOT_KEYS commonest of the latter are broadcast, so that their rows need not meet to learn them.
    """
    counts = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "counts", plain=True)
    hot = counts.filter(F.col("rows") > KEY_ROWS).orderBy(F.desc("rows"), "key").limit(HOT_KEYS).select("key", F.col("rows").alias("hot"))
    marked = rows.join(F.broadcast(hot), "key", "left")
    marked = marked.withColumn("at", F.when(F.col("hot").isNull(), F.col("key")).otherwise(F.xxhash64("doc", "pos")))
    marked = marked.join(counts.select(F.col("key").alias("at"), "rows"), "at", "left").withColumn("rows", F.coalesce("hot", "rows")).filter("rows > 1")
    parts = F.ceil(F.col("rows") / F.lit(KEY_ROWS)).cast("long")
    part = F.when(parts > 1, F.shiftleft(parts, 32) + F.pmod(F.xxhash64("doc", "pos"), parts)).otherwise(F.lit(-1).cast("long"))
    return marked.select("key", "doc", "pos", part.alias("part"))


class Sieve:
    """A bitmap of documents with FILTER_SPARE bits each; what it lets through wrongly does no harm to a join that follows."""

    def __init__(self, wanted: DataFrame, bits: int):
        self.bits = bits
        at = self.place("doc")
        cells = wanted.select(F.floor(at / 32).cast("int").alias("cell"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 32).cast("int")).alias("b"))
        cells = cells.groupBy("cell").agg(F.bit_or("b").alias("b")).toPandas()  # bits / 32 rows at most
        table = np.zeros(bits // 32, np.uint32)
        table[cells["cell"].to_numpy(int)] = cells["b"].to_numpy(np.int64).astype(np.uint32)
        self.held = wanted.sparkSession.sparkContext.broadcast(table)  # 2 x FILTER_MOST bits at most

    def place(self, doc: str) -> Column:
        return F.pmod(F.xxhash64(doc), F.lit(self.bits))

    def __reduce__(self):
        return _sieve, (self.bits, self.held)

    def holds(self, at: np.ndarray) -> np.ndarray:
        return ((self.held.value[at // 32] >> (at % 32).astype(np.uint32)) & 1) == 1


def _sieve(bits: int, held) -> Sieve:
    out = Sieve.__new__(Sieve)
    out.bits, out.held = bits, held
    return out


def sieve(wanted: DataFrame) -> Sieve | None:
    """Of wanted(doc), or none if it has more documents than FILTER_MOST bits serve."""
    size = wanted.count() * FILTER_SPARE
    return None if size > FILTER_MOST else Sieve(wanted, max(FILTER_LEAST, 1 << size.bit_length()))


def filtered(docs: DataFrame, some: Sieve | None) -> DataFrame:
    """Rows of ``docs`` that may be wanted; all of them without a sieve."""
    if some is None:
        return docs
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = some.holds(batch.column(len(names)).to_numpy())
            yield pa.RecordBatch.from_arrays(batch.columns[: len(names)], names=names).filter(pa.array(keep))

    return docs.withColumn("_lf_at", some.place("doc_id")).mapInArrow(run, docs.schema)


def with_rows(docs: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """doc_id, text and a list of each of ``columns``: documents that have rows(doc, ...), with theirs, each different one once."""
    listed = materialize(rows.groupBy("doc").agg(F.collect_set(F.struct(*columns)).alias("_r")).select("doc", *[F.col(f"_r.{c}").alias(f"_{c}") for c in columns]), "listed", plain=True)
    texts = filtered(text_rows(docs.filter("doc_id IS NOT NULL")), sieve(listed.select("doc")))
    return texts.join(listed, F.col("doc_id") == F.col("doc")).select("doc_id", "text", *[f"_{c}" for c in columns])


def flat_lists(batch: pa.RecordBatch, columns: list[int]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(first item of each row and one more, the values of each of the list columns, which are of one length in a row)."""
    at = batch.column(columns[0]).offsets.to_numpy()
    return at, [batch.column(c).values.to_numpy() for c in columns]


def run_lists(column: pa.Array) -> Iterator[np.ndarray]:
    values, at = column.values.to_numpy(), column.offsets.to_numpy()
    for k in range(len(at) - 1):
        yield values[at[k] : at[k + 1]]


def halves(spec: Windows, start: np.ndarray, offset: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(which runs, first window, windows, first and last unit that all windows of the half hold) for left and right halves.

    A window that starts up to ``half`` before the anchor holds the units from the anchor to its end at that distance; one that starts
    farther off holds the ``half`` + 1 units before the anchor and the anchor.
    """
    anchor = start + offset
    first_right = np.maximum(start, anchor - spec.half)
    right = np.flatnonzero(first_right < start + n)
    yield right, first_right[right], (start + n - first_right)[right], anchor[right], anchor[right] - spec.half + spec.length
    left = np.flatnonzero(start < anchor - spec.half)
    stop = np.minimum(start + n, anchor - spec.half)
    yield left, start[left], (stop - start)[left], anchor[left] - spec.half - 1, anchor[left] + spec.gram


def column_bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, at = column_bytes(column)
    return data[at[0] : at[-1]], at - at[0]


def whole_groups(batches: Iterator[pa.RecordBatch], weight, limit: int) -> Iterator[pa.Table]:
    """Rows sorted by their first two columns, cut between groups of these as soon as ``weight(batch)``, added up, reaches ``limit``."""
    held: list[pa.RecordBatch] = []
    heavy = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        heavy += weight(batch)
        if heavy < limit:
            continue
        key, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        change = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1]))
        if not len(change):
            # rows of one group alone, or the end of what is held
            before = held[-2] if len(held) > 1 else None
            if before is not None and (before.column(0)[-1].as_py(), before.column(1)[-1].as_py()) != (int(key[0]), int(part[0])):
                yield pa.Table.from_batches(held[:-1])
                held, heavy = [batch], weight(batch)
            continue
        cut = int(change[-1]) + 1
        yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
        held = [batch.slice(cut)]
        heavy = weight(held[0])
    if held:
        yield pa.Table.from_batches(held)


def stretches(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, n) of the maximal stretches of consecutive starts, which need not be in order or different."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)
    head = np.flatnonzero(first)
    if not len(head):
        return doc, start, start
    last = np.concatenate([head[1:], [len(doc)]]) - 1
    return doc[head], start[head], start[last] - start[head] + 1


def finish(docs: DataFrame, removed: DataFrame, judge, schema: str) -> DataFrame:
    """``judge(part of a batch of doc_id, text, starts, counts)`` over all rows of ``docs``, with their stretches of removed windows(doc, start, n).

    Only documents that have some are shuffled, to meet their list; the others are judged where they are read.
    """
    listed = removed.groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("_r")).select("doc", F.col("_r.start").alias("starts"), F.col("_r.n").alias("counts"))
    listed = materialize(listed, "removed", plain=True)
    rows, some = text_rows(docs), sieve(listed.select("doc"))
    none = F.array().cast("array<long>")
    hit = filtered(rows.filter("doc_id IS NOT NULL"), some).join(listed, F.col("doc_id") == F.col("doc"), "left")
    hit = hit.select("doc_id", "text", F.coalesce("starts", none).alias("starts"), F.coalesce("counts", none).alias("counts"))
    # one function for each stage: every one more is a worker more that an executor has memory for
    rest = rows.select("doc_id", "text", none.alias("starts"), none.alias("counts"), F.lit(0).cast("long").alias("at") if some is None else some.place("doc_id").alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, _, _ in slices(batch.column(1)):
                yield judge(batch.slice(i, j - i))

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            if some is not None:
                keep = keep | ~some.holds(batch.column(4).to_numpy())
            yield from run([batch.filter(pa.array(keep))])

    return hit.mapInArrow(run, schema).unionByName(rest.mapInArrow(apart, schema))
