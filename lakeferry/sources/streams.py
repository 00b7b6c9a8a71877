"""Rows of text files that are one long value, as they are read: what a document lists, and lists of literals. No file is held whole."""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Characters read at a time, and of rows in a batch.
CHUNK, BATCH_CHARS = 1 << 18, 1 << 22
_SPACE = re.compile(r"\s*")
_NUMBER = re.compile(r"[-+.\w]*")
#: Values of a list that go together, and as many of them that are no lists or objects, each with the comma behind it.
BLOCK = 32
_SCALARS = re.compile(r'''(?>\s*+(?:"(?:[^"\\]|\\.)*+"|[-+.\w]++)\s*+,){%d}''' % BLOCK, re.S)
_STRUCTURE = re.compile(r"'(?:[^'\\]|\\.|'')*'|[()\[\]{}]", re.S)


class Text:
    """The characters of a stream, from a place on."""

    def __init__(self, stream):
        self.stream, self.decoder, self.buf, self.at, self.over = stream, codecs.getincrementaldecoder("utf-8-sig")("replace"), "", 0, False

    def more(self) -> bool:
        """Read on; False at the end."""
        if self.over:
            return False
        chunk = self.stream.read(CHUNK)
        self.over = not chunk
        self.buf, self.at = self.buf[self.at :] + self.decoder.decode(chunk or b"", self.over), 0
        return True

    def peek(self) -> str:
        """The next character that is no space; nothing at the end."""
        while True:
            self.at = _SPACE.match(self.buf, self.at).end()
            if self.at < len(self.buf) or not self.more():
                return self.buf[self.at : self.at + 1]

    def take(self, wanted: str) -> bool:
        if self.peek() != wanted:
            return False
        self.at += 1
        return True

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise ValueError(f"expected {wanted!r}, found {self.peek()!r}")

    def value(self) -> str:
        """The text of the next JSON value."""
        self.peek()
        while True:
            try:
                end = json.JSONDecoder(strict=False).raw_decode(self.buf, self.at)[1]
                # a number may go on behind what has been read
                if _NUMBER.match(self.buf, end).end() < len(self.buf) or not self.more():
                    break
            except json.JSONDecodeError:
                if not self.more():
                    raise
        text, self.at = self.buf[self.at : end], end
        return text


def _listed(text: Text) -> Iterator[str]:
    text.need("[")
    while not text.take("]"):
        yield text.value()
        if not text.take(","):
            text.need("]")
            return


def _keys(text: Text) -> Iterator[str]:
    """The keys of an object, each before its value is read."""
    text.need("{")
    while not text.take("}"):
        yield json.loads(text.value())
        if not text.take(","):
            text.need("}")
            return


def data_items(stream) -> Iterator[str]:
    """The items of an object's ``data``."""
    text = Text(stream)
    for key in _keys_with_colon(text):
        if key == "data":
            yield from _listed(text)
        else:
            text.value()


def _keys_with_colon(text: Text) -> Iterator[str]:
    for key in _keys(text):
        text.need(":")
        yield key


def object_values(stream) -> Iterator[str]:
    """The values of an object."""
    text = Text(stream)
    for _ in _keys_with_colon(text):
        yield text.value()


def _blocks(text: Text) -> Iterator[str]:
    """The items of a list, BLOCK at a time, each time as a list's text."""
    text.need("[")
    held: list[str] = []
    more = not text.take("]")
    while more:
        many = None if held else _SCALARS.match(text.buf, text.at)
        if many:
            text.at = many.end()
            yield f"[{many[0][:-1]}]"
            continue
        held.append(text.value())
        more = text.take(",")
        if not more:
            text.need("]")
        if len(held) == BLOCK:
            yield f"[{','.join(held)}]"
            held = []
    if held:
        yield f"[{','.join(held)}]"


def _lists(text: Text, names: list[str] | None) -> Iterator[tuple[int, int, str]]:
    """(column, block, its items) of an object's lists by their names, or of a list's lists; others are passed by."""
    at = {n: i for i, n in enumerate(names or [])}
    if names is None:
        text.need("[")
        keys = iter(lambda: None if text.take("]") else "", None)
    else:
        keys = _keys_with_colon(text)
    seen = set()
    for place, key in enumerate(keys):
        column = place if names is None else at.get(key)
        if column in seen:
            raise ValueError(f"the file has {key!r} twice")
        if text.peek() == "[":
            for block, items in enumerate(_blocks(text)):
                if column is not None:
                    yield column, block, items
        elif text.value() != "null" and column is not None:
            raise ValueError(f"column {names[column] if names else column!r} is no list")
        if column is not None:
            seen.add(column)
        if names is None and not text.take(","):
            text.need("]")
            return


def column_blocks(layout: str, names: list[str]) -> Callable:
    """Of a file that holds column after column: batches of its name, block, column and the block's items, as a list's text."""

    def found(stream) -> Iterator[tuple[int, int, str]]:
        text = Text(stream)
        if not text.peek():
            return
        if layout == "meta":
            had = False
            for key in _keys_with_colon(text):
                if key != "data":
                    text.value()
                    continue
                if had:
                    raise ValueError("the file has 'data' twice")
                had = True
                if text.peek() == "{":
                    yield from _lists(text, names)
                elif text.peek() != "n" or text.value() != "null":
                    raise ValueError("data is no object")
        else:
            yield from (x for x in _lists(text, None if layout == "compact" else names) if x[0] < len(names))

    def read(stream, uri: str) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, str]] = []
        size = 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([uri] * len(held)), pa.array([b for _, b, _ in held], pa.int64()), pa.array([c for c, _, _ in held], pa.int32()), pa.array([t for _, _, t in held], pa.string())], ["file", "block", "at", "items"])
        for x in found(stream):
            held.append(x)
            size += len(x[2])
            if size >= BATCH_CHARS:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()

    return read


def tuples(stream) -> Iterator[str]:
    """The texts ``(...)`` of a list of tuples of literals."""
    text = Text(stream)
    while text.peek() not in ("", ";"):
        if text.take(","):
            continue
        if text.peek() != "(":
            raise ValueError(f"expected '(', found {text.peek()!r}")
        depth, at = 0, text.at
        while True:
            found = _STRUCTURE.search(text.buf, at)
            quote = text.buf.find("'", at)
            if found is None or (0 <= quote < found.start()):
                # nothing more, or a text that goes on behind what has been read
                begun = at - text.at
                if not text.more():
                    raise ValueError("the file ends within a row")
                at = text.at + begun
                continue
            if found[0][0] == "'" and found.end() == len(text.buf) and not text.over:
                # a quote at the end may be the first of two
                begun = at - text.at
                text.more()
                at = text.at + begun
                continue
            at = found.end()
            depth += {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(found[0], 0)
            if not depth:
                break
        yield text.buf[text.at : at]
        text.at = at


def batched(items: Callable) -> Callable:
    """``items(stream)`` as batches of one column of text."""

    def read(stream) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for x in items(stream):
            held.append(x)
            size += len(x)
            if size >= BATCH_CHARS:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])

    return read
