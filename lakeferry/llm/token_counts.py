"""Token counts with a whole-token shortcut.

Offline, every vocabulary string is encoded alone, and those that come out as the one token they are form a proven table. A
text is cut at white space, which no pre-token crosses; each distinct word is cut into pre-tokens, those in the table count 1 at
once, and only the rest goes through the library's merges. Words with other than plain ASCII letters, or that may hold a
special string, go to the library whole, so that its normaliser and its treatment of special strings decide.
Counts of words are kept in a table of bounded size in each worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeferry.llm.textcore import column_bytes
from lakeferry.runtime import ship

#: Words whose counts a worker keeps, at most; the table starts anew beyond.
CACHE_WORDS = 1 << 19
#: Pre-tokens of a lower-case ASCII word, as the tokenizer's own pattern cuts it.
PRETOKEN = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_SPECIAL = b"<|"


def prove_whole_tokens(tokenizer) -> frozenset[bytes]:
    """Lower-case ASCII strings w whose pre-token is w itself and which encode alone as exactly one token.

    Vocabulary strings end with the word-end mark; each is put through the tokenizer, none is assumed.
    """
    end = "</w>"
    words = [w[: -len(end)] for w in tokenizer.get_vocab(with_added_tokens=False) if w.endswith(end) and len(w) > len(end)]
    words = [w for w in words if w.isascii() and w == w.lower() and PRETOKEN.findall(w.encode()) == [w.encode()] and _SPECIAL.decode() not in w]
    found = tokenizer.encode_batch(words, add_special_tokens=False)
    return frozenset(w.encode() for w, e in zip(words, found, strict=True) if len(e.ids) == 1)


class WordCounter:
    """Tokens of each white-space separated word, remembered."""

    def __init__(self, tokenizer, whole: frozenset[bytes], limit: int = CACHE_WORDS):
        self.tokenizer, self.whole, self.limit = tokenizer, whole, limit
        self.words: dict[bytes, int] = {}
        self.parts: dict[bytes, int] = {}

    def _encode(self, strings: list[bytes]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast([s.decode("utf-8", "replace") for s in strings], add_special_tokens=False)]

    def learn(self, words: set[bytes]) -> None:
        """Fill the table for the words not yet in it."""
        if len(self.words) + len(words) > self.limit:
            self.words.clear()
        if len(self.parts) > self.limit:
            self.parts.clear()
        cut, odd, rest = {}, [], set()
        for w in words:
            if w.isascii() and _SPECIAL not in w and not _CONTROL.search(w):
                pieces = cut[w] = PRETOKEN.findall(w.lower())
                rest.update(p for p in pieces if p not in self.whole and p not in self.parts)
            else:
                odd.append(w)
        if rest:
            rest = list(rest)
            self.parts.update(zip(rest, self._encode(rest), strict=True))
        for w, pieces in cut.items():
            self.words[w] = sum(1 if p in self.whole else self.parts[p] for p in pieces)
        if odd:
            self.words.update(zip(odd, self._encode(odd), strict=True))

    def count(self, text: bytes) -> int:
        words = text.split()
        get = self.words.get
        try:
            return sum(map(self.words.__getitem__, words))
        except KeyError:
            new = {w for w in words if get(w) is None}
            if len(new) > self.limit:  # one text with more distinct words than the table holds
                return sum(self._count_apart(words[i : i + self.limit // 2]) for i in range(0, len(words), self.limit // 2))
            size = len(self.words) + len(new)
            self.learn(new if size <= self.limit else set(words))
            return sum(map(self.words.__getitem__, words))

    def _count_apart(self, words: list[bytes]) -> int:
        self.learn(set(words))
        return sum(map(self.words.__getitem__, words))


#: The library's white space holds some control characters that do not end words here; such words go to it whole.
_CONTROL = re.compile(rb"[\x00-\x1f\x7f]")


def _load(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, n_bytes, n_tokens, over_limit``, a row per row of ``docs``.

    ``path``: the tokenizer's file, present on every machine. Null and empty texts have 0 bytes and tokens. Rows that repeat
    are counted each. An empty table gives no rows. Columns other than the two named are not looked at.
    """
    ship(docs.sparkSession)
    whole = docs.sparkSession.sparkContext.broadcast(prove_whole_tokens(_load(path)))  # as large as the vocabulary at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = None
        for batch in batches:
            counter = counter or WordCounter(_load(path), whole.value)
            data, at = column_bytes(batch.column(1))
            raw = data.tobytes() if len(data) < 1 << 28 else memoryview(data)
            n = np.fromiter((counter.count(bytes(raw[at[i] : at[i + 1]])) for i in range(len(at) - 1)), np.int64, len(at) - 1)
            size = np.diff(at)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
