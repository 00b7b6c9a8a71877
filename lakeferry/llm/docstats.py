"""Statistics of whole documents, a row each, for the quality models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeferry.llm.textcore import SPACE, covered, find_words, hash_spans, mix, per_document, run_hashes, segment_ids, slices
from lakeferry.runtime import ship

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
WINDOW = 8
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Shares in [0, 1] or means, all from the text alone.
FEATURES = ["log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "bang_share", "digit_share", "punct_share", "distinct_share", "line_words"]


def document_stats(buf: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """Of every document: the counts in BASE, and what FEATURES needs besides."""
    docs = len(bounds) - 1
    starts, ends, per = find_words(buf, bounds)
    ids = segment_ids(per).astype(np.uint64)
    h = hash_spans(buf, starts, ends)
    lead = (buf & 0xC0) != 0x80
    out = {"n_words": np.diff(per), "word_chars": per_document(lead & ~SPACE[buf], bounds), "n_symbols": per_document(SYMBOLS[buf], bounds)}
    # lines: they end at newlines and at the document's end
    cut = np.flatnonzero(buf == 10)
    first = np.unique(np.concatenate([bounds[:-1], cut + 1]))
    first = first[first < len(buf)]
    doc = np.searchsorted(bounds, first, "right") - 1
    last = np.minimum(np.concatenate([first[1:], [len(buf)]]), bounds[doc + 1]) if len(first) else first
    last = last - ((last > first) & (buf[np.maximum(last, 1) - 1] == 10)) if len(first) else last
    real = np.searchsorted(starts, last) > np.searchsorted(starts, first)
    first, last, doc = first[real], last[real], doc[real]
    lines = np.bincount(doc, minlength=docs)
    key = mix(hash_spans(buf, first, last) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    keep = np.unique(key, return_index=True)[1]
    out["n_dup_lines"] = lines - np.bincount(doc[keep], minlength=docs)
    out["n_lines"] = lines
    # windows of eight words that the text has twice
    windows = run_hashes(h, WINDOW)
    at = np.flatnonzero(ids[: len(windows)] == ids[WINDOW - 1 :]) if len(windows) else np.zeros(0, np.int64)
    key = mix(windows[at] + ids[at] * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    out["n_repeat_words"] = per_document(covered(at[twice], WINDOW, len(h)), per)
    key = mix(h + ids * np.uint64(0x9E3779B97F4A7C15))
    keep = np.unique(key, return_index=True)[1]
    out["n_distinct"] = np.bincount(ids[keep].astype(np.int64), minlength=docs)
    upper = ((buf >= 65) & (buf <= 90)) | ((buf == 195) & (np.concatenate([buf[1:], [0]]) >= 128) & (np.concatenate([buf[1:], [0]]) <= 158))
    lower = ((buf >= 97) & (buf <= 122)) | ((buf == 195) & (np.concatenate([buf[1:], [0]]) > 158))
    out["n_upper"], out["n_lower"] = per_document(upper, bounds), per_document(lower, bounds)
    out["n_bang"] = per_document(buf == 33, bounds)
    out["n_digit"] = per_document((buf >= 48) & (buf <= 57), bounds)
    out["n_punct"] = per_document((buf < 128) & ~SPACE[buf] & ~(((buf | 32) >= 97) & ((buf | 32) <= 122)) & ~((buf >= 48) & (buf <= 57)), bounds)
    return out


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """(documents, FEATURES); of an empty document all 0."""
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    return np.column_stack(
        [
            np.log1p(s["n_words"]),
            s["word_chars"] / words,
            s["n_symbols"] / chars,
            s["n_dup_lines"] / np.maximum(s["n_lines"], 1),
            s["n_repeat_words"] / words,
            s["n_upper"] / np.maximum(s["n_upper"] + s["n_lower"], 1),
            s["n_bang"] / chars,
            s["n_digit"] / chars,
            s["n_punct"] / chars,
            s["n_distinct"] / words,
            np.log1p(s["n_words"] / np.maximum(s["n_lines"], 1)),
        ]
    )


def text_rows(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the text's bytes (null: none) and ``more``."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), *more)


def held_out(doc_id=None):
    """Whether a document's labels are kept from every model: the CRC-32 of its id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """``doc_id, text, label`` of up to ``limit`` labelled documents that are not held out, those of least hash of their id.

    The ids that are joined by broadcast are ``limit`` at most. Null labels don't count; of a document labelled twice the least label does.
    """
    known = labels.filter(F.col(label).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("label"))
    known = known.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(limit)
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")


def sample_features(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of the labelled sample, on the driver: ``limit`` rows at most."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.concatenate([np.zeros((0, len(FEATURES))), *[features(document_stats(buf, bounds)) for _, _, buf, bounds in slices(batch.column(1))]])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[pa.array(x[:, j]) for j in range(x.shape[1])]], ["doc_id", "label", *FEATURES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = text_rows(labelled_sample(docs, labels, label, limit), "label").mapInArrow(run, f"doc_id {kind}, label int, " + ", ".join(f"{f} double" for f in FEATURES))
    got = rows.toPandas().sort_values("doc_id", kind="stable").head(limit)
    return got[FEATURES].to_numpy(float), got["label"].to_numpy(int)
