"""Vectorised text kernels shared by the corpus operators.

Everything here works on one Arrow column of UTF-8 bytes at a time, in slices of bounded size, with numpy only:
word boundaries, 64-bit word hashes, hashes of runs of words or bytes, and sliding-window minimisers.
Words are the maximal runs of bytes outside ``\\x20 \\x09-\\x0D``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of text handled at a time, unless one document alone is longer.
SLICE_BYTES = 1 << 20

_U = np.uint64
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
#: Odd multiplier of the rolling hashes.
ROLL = _U(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def power(k: int) -> np.uint64:
    """ROLL to the k-th power, modulo 2**64."""
    return _U(pow(int(ROLL), k, 1 << 64))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary or string column without copying it; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)), at


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, bounds from 0) for runs of whole documents of up to ``limit`` bytes, or one document."""
    data, at = column_bytes(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def find_words(buf: np.ndarray, bounds: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document and one more) of the words, runs of bytes not in ``gap``; no word crosses a document's bound."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    solid = ~gap[buf]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    at = bounds[:-1][bounds[:-1] < len(buf)]
    first[at] = solid[at]
    at = bounds[1:][bounds[1:] > 0] - 1
    last[at] = solid[at]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, bounds)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, eight bytes at a time."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))
    length = ends - starts
    h = length.astype(np.uint64) * _U(0xD6E8FEB86659FD93)
    h = mix(h ^ (lanes[starts] & _LOW[np.minimum(length, 8)]) * ROLL)
    done, left = 8, np.flatnonzero(length > 8)
    while len(left):
        size = length[left]
        h[left] = mix(h[left] ^ (lanes[starts[left] + done] & _LOW[np.minimum(size - done, 8)]) * ROLL)
        done += 8
        left = left[size > done]
    return h


def word_hashes(buf: np.ndarray, bounds: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each document and one more)."""
    if lower:
        buf = LOWER[buf]
    starts, ends, per = find_words(buf, bounds)
    return hash_spans(buf, starts, ends), per


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive values (bounds are not looked at), by doubling and adding lengths."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    have, out = 1, h
    while have < k:
        more = min(have, k - have)  # the second part overlaps none and is the first ``more`` values' hash
        part = out if more == have else run_hashes(h, more)
        n = len(h) - have - more + 1
        out = out[:n] * power(more) + part[have : have + n]
        have += more
    return mix(out) if k > 1 else mix(h * ROLL)


def shingle_hashes(h: np.ndarray, per: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first of each document and one more) of the k-word shingles; a shorter document has its whole sequence as one, an empty one none."""
    n = np.diff(per)
    each = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(each)])
    out = np.zeros(at[-1], np.uint64)
    full = n >= k
    if full.any():
        rolled = run_hashes(h, k)
        # positions of the windows that lie within one document
        idx = np.arange(each[full].sum()) + np.repeat(per[:-1][full] - np.concatenate([[0], np.cumsum(each[full])[:-1]]), each[full])
        into = np.arange(len(idx)) + np.repeat(at[:-1][full] - np.concatenate([[0], np.cumsum(each[full])[:-1]]), each[full])
        out[into] = rolled[idx]
    for m in range(1, k):
        docs = np.flatnonzero(n == m)
        if len(docs):
            x = np.zeros(len(docs), np.uint64)
            for j in range(m):
                x = x * ROLL + h[per[docs] + j]
            out[at[docs]] = mix(x + _U(m))
    return out, at


def window_minimum(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by block prefixes and suffixes."""
    n = len(v)
    if n < w:
        return v[:0]
    if w == 1:
        return v
    m = -(-n // w) * w
    x = np.full(m, np.iinfo(v.dtype).max, v.dtype)
    x[:n] = v
    x = x.reshape(-1, w)
    left = np.minimum.accumulate(x, axis=1).ravel()
    right = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def minimizers(h: np.ndarray, w: int) -> np.ndarray:
    """For every w consecutive hashes the position of the least (the leftmost of equals). Equal windows choose equal offsets."""
    bits = max(1, int(len(h)).bit_length())
    v = (h >> _U(bits) << _U(bits)) | np.arange(len(h), dtype=np.uint64)
    return (window_minimum(v, w) & _U((1 << bits) - 1)).astype(np.int64)


def segment_ids(per: np.ndarray) -> np.ndarray:
    """Document number of every item, from the first item of each document and one more."""
    return np.repeat(np.arange(len(per) - 1), np.diff(per))


def per_document(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each document's stretch."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def covered(starts: np.ndarray, length: int | np.ndarray, n: int) -> np.ndarray:
    """Mask of the n items that the stretches cover, as far as they reach."""
    edge = np.bincount(np.minimum(starts, n), minlength=n + 1) - np.bincount(np.minimum(starts + length, n), minlength=n + 1)
    return np.cumsum(edge[:n]) > 0
