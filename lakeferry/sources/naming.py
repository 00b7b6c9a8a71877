"""Columns of files by their names: what a file calls its columns, and where the wanted ones are among them."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

from lakeferry.sources import files
from lakeferry.types.grammar import FileType

#: Up to so many files the driver reads the heads itself; more are read by tasks.
HERE = 16


def places(have: list[str], columns: list[tuple[str, FileType]]) -> list[int | None]:
    """Where in a file's columns each wanted one is. One that the file lacks has none, and is null; what else the file has is passed by.

    A file that has none of the wanted columns is refused, since all its rows would be empty.
    """
    at = {n: i for i, n in reversed(list(enumerate(have)))}
    found = [at.get(n) for n, _ in columns]
    if all(f is None for f in found):
        raise ValueError(f"the file has none of the columns {', '.join(n for n, _ in columns)}; it has {', '.join(have) or 'none'}")
    return found


def first_records(uri: str, codec: str, n: int, quoted: bool) -> list[str]:
    """The first ``n`` lines of a file; with ``quoted`` line ends within double quotes end no line."""
    data = b""
    with files.reading(uri, codec) as stream:
        while True:
            chunk = stream.read(1 << 16)
            data += chunk
            ends, at = [], -1
            while len(ends) < n and (at := data.find(b"\n", at + 1)) >= 0:
                if not quoted or data.count(b'"', 0, at) % 2 == 0:
                    ends.append(at)
            if len(ends) == n or not chunk:
                break
    cuts = [-1, *ends] if len(ends) == n or not data[(ends[-1] if ends else -1) + 1 :] else [-1, *ends, len(data)]
    return [data[a + 1 : b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)]


def heads(spark: SparkSession, paths: list[str], n: int, quoted: bool, codec_of: Callable[[str], str]) -> list[tuple[list[str], list[str]]]:
    """[(files, their first ``n`` lines)]: files that begin alike are together. Files without a line are left out."""
    if codec_of(paths[0]) == "snappy":
        each = [(p, [r[0] for r in spark.read.option("lineSep", "\n").text(p).limit(n).collect()]) for p in paths]
    elif len(paths) <= HERE:
        each = [(p, first_records(p, codec_of(p), n, quoted)) for p in paths]
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                uris = batch.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([first_records(u, codec_of(u), n, quoted) for u in uris], pa.list_(pa.string()))], ["path", "head"])

        each = [(r[0], list(r[1])) for r in files.paths(spark, paths).mapInArrow(run, "path string, head array<string>").collect()]  # a row for each file
    groups: dict[tuple[str, ...], list[str]] = {}
    for path, head in each:
        if head:
            groups.setdefault(tuple(head), []).append(path)
    return [(found, list(head)) for head, found in groups.items()]


def csv_names(line: str) -> list[str]:
    return next(csv.reader(io.StringIO(line.rstrip("\r"), newline="")), [])


def json_names(line: str) -> list[str]:
    return [str(x) for x in json.loads(line)]
