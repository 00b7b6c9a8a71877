"""Table definitions from files."""

from __future__ import annotations

import json
import logging
import uuid

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import types as S

from lakeferry.operators import copy
from lakeferry.plans import catalog
from lakeferry.plans.options import CopyOptions, codec_of
from lakeferry.runtime import scratch
from lakeferry.sources import files, formats
from lakeferry.sources.binary import Source, avro_head
from lakeferry.sources.textual import csv_head, head_lines
from lakeferry.sources.urls import locate
from lakeferry.types.grammar import FileType, parse_structure, parse_type
from lakeferry.types.mapping import column_field, file_type

log = logging.getLogger("lakeferry")


def describe(spark: SparkSession, url: str, options: CopyOptions) -> list[tuple[str, FileType]]:
    """The file's columns. An explicit structure is taken at its word, and the file isn't opened."""
    if options.structure and options.structure.lower() != "auto":
        found = parse_structure(options.structure)
        for i, (name, _) in enumerate(found, 1):
            if not name:
                raise ValueError(f"structure column {i} has no name")
        return found  # type: ignore[return-value]
    location = locate(url, options)
    paths = copy.files_at(spark, url, options)
    name = formats.format_name(options, paths[0])
    found = _inferred(spark, name, paths, codec_of(location.path, options.compression))
    if not found:
        raise ValueError(f'no columns found at "{url}"')
    return found


def _of_spark(schema: S.StructType, nullable: dict[str, bool] | None = None) -> list[tuple[str, FileType]]:
    return [(f.name, file_type(S.StructField(f.name, f.dataType, (nullable or {}).get(f.name, True)))) for f in schema.fields]


def _inferred(spark: SparkSession, name: str, paths: list[str], codec: str) -> list[tuple[str, FileType]]:
    first = paths[0]
    if name in ("parquet", "orc"):
        nullable = None
        if name == "parquet":
            import pyarrow.parquet as pq

            fs, path = files.filesystem(first)
            nullable = {f.name: f.nullable for f in pq.read_schema(path, filesystem=fs)}
        schema = spark.read.format(name).load(first).schema
        schema = S.StructType([S.StructField(f.name, S.TimestampType() if isinstance(f.dataType, S.TimestampNTZType) else f.dataType) for f in schema.fields])
        return _of_spark(schema, nullable)
    if name.endswith("withnamesandtypes"):
        if name.startswith("rowbinary"):
            with files.reading(first, codec) as stream:
                s = Source(stream)
                n = s.varint()
                words = [s.take(s.varint()).decode() for _ in range(2 * n)]
            return list(zip(words[:n], map(parse_type, words[n:]), strict=True))
        if name.startswith("csv"):
            names, types = csv_head(spark, first, 2)
            return list(zip(names, types, strict=True))
        lines = head_lines(spark, first, 2)
        if name.startswith("json"):
            return list(zip(json.loads(lines[0]), map(parse_type, json.loads(lines[1])), strict=True))
        plain = (lambda s: s) if "raw" in name else _unescape
        return [(plain(n), parse_type(plain(t))) for n, t in zip(lines[0].split("\t"), lines[1].split("\t"), strict=True)]
    if name == "native":
        with files.reading(first, codec) as stream:
            return _native_head(Source(stream))
    if name == "avro":
        with files.reading(first, codec) as stream:
            record, _ = avro_head(Source(stream))
        return [(f["name"], _avro_type(f["type"])) for f in record["fields"]]
    if name in ("arrow", "arrowstream"):
        import pyarrow as pa
        from pyspark.sql.pandas.types import from_arrow_schema

        with files.reading(first, codec) as stream:
            schema = (pa.ipc.open_stream(stream) if name == "arrowstream" else pa.ipc.open_file(pa.BufferReader(stream.read()))).schema
        return _of_spark(from_arrow_schema(schema), {f.name: f.nullable for f in schema})
    if name in ("json", "jsoncompact", "jsoncolumnswithmetadata"):
        text = spark.read.text(first, wholetext=True).first()[0]
        return [(c["name"], parse_type(c["type"])) for c in json.loads(text)["meta"]]
    if name in ("csv", "csvwithnames"):
        schema = spark.read.options(header=name != "csv", inferSchema=True, quote='"', escape='"', multiLine=True, nullValue="\\N").csv(_head(spark, first, codec, True)).schema
        return _loose(schema, name == "csv")
    if name in ("tabseparated", "tabseparatedraw", "tabseparatedwithnames", "tabseparatedrawwithnames", "customseparated", "customseparatedwithnames"):
        schema = spark.read.options(header="names" in name, inferSchema=True, sep="\t", quote="", nullValue="\\N").csv(_head(spark, first, codec, False)).schema
        return _loose(schema, "names" not in name)
    if name in ("jsoneachrow", "jsonstringseachrow"):
        schema = spark.read.json(_head(spark, first, codec, False)).schema
        order = list(json.loads(next((x for x in head_lines(spark, first, 1)), "{}")))
        fields = sorted(schema.fields, key=lambda f: order.index(f.name) if f.name in order else len(order))
        return _of_spark(S.StructType(fields))
    raise ValueError(f"columns of format {name} cannot be told; give a structure")


#: Rows, and bytes, at a file's beginning that its columns are told from.
HEAD_ROWS, HEAD_BYTES = 25_000, 32 << 20


def _head(spark: SparkSession, first: str, codec: str, quoted: bool) -> str:
    """A file of the first rows of another, so that telling columns costs the same however large the files are."""
    if codec == "snappy":
        return first
    data = bytearray()
    with files.reading(first, codec) as stream:
        while len(data) < HEAD_BYTES and data.count(b"\n") <= HEAD_ROWS and (chunk := stream.read(1 << 20)):
            data += chunk
        whole = len(data) < HEAD_BYTES and not stream.read(1)
    if not whole or data.count(b"\n") > HEAD_ROWS:
        buf = np.frombuffer(bytes(data), np.uint8)
        ends = np.flatnonzero((buf == 10) & ((np.cumsum(buf == 34) % 2 == 0) if quoted else True))
        if len(ends):
            del data[int(ends[min(HEAD_ROWS, len(ends)) - 1]) + 1 :]
    path = f"{scratch(spark)}/head-{uuid.uuid4().hex}.txt"
    fs, p = files.hadoop(spark, path)
    fs.mkdirs(p.getParent())
    with files.writing(fs.makeQualified(p).toString()) as out:
        out.write(bytes(data))
    return path


def _loose(schema: S.StructType, numbered: bool) -> list[tuple[str, FileType]]:
    """Inferred from text: whole numbers are of 64 bits, all may be null, columns without names are c1, c2 and so on."""
    out = []
    for i, f in enumerate(schema.fields, 1):
        kind = S.LongType() if isinstance(f.dataType, S.IntegerType) else f.dataType
        kind = S.TimestampType() if isinstance(kind, S.TimestampNTZType) else kind
        out.append(S.StructField(f"c{i}" if numbered else f.name, kind))
    return _of_spark(S.StructType(out))


def _unescape(s: str) -> str:
    return s.replace("\\\\", "\0").replace("\\t", "\t").replace("\\n", "\n").replace("\\'", "'").replace("\0", "\\")


def _native_head(s: Source) -> list[tuple[str, FileType]]:
    """Names and types of the first block, whose data is read over."""
    from lakeferry.sources.binary import _get_column

    if s.ended():
        return []
    n, rows = s.varint(), s.varint()
    out = []
    for _ in range(n):
        name, kind = s.take(s.varint()).decode(), parse_type(s.take(s.varint()).decode())
        _get_column(kind, s, rows)
        out.append((name, kind))
    return out


def _avro_type(a) -> FileType:
    if isinstance(a, list):
        inner = _avro_type(next(x for x in a if x != "null"))
        return inner if inner.name in ("Array", "Map", "Tuple") or "null" not in a else FileType("Nullable", (inner,))
    if isinstance(a, dict):
        if a.get("logicalType") == "date":
            return FileType("Date32")
        if str(a.get("logicalType", "")).startswith("timestamp"):
            return FileType("DateTime64", (6, "UTC"))
        if a["type"] == "array":
            return FileType("Array", (_avro_type(a["items"]),))
        if a["type"] == "map":
            return FileType("Map", (FileType("String"), _avro_type(a["values"])))
        if a["type"] == "record":
            return FileType("Tuple", tuple(_avro_type(f["type"]) for f in a["fields"]), tuple(f["name"] for f in a["fields"]))
        return _avro_type(a["type"])
    return FileType({"boolean": "Bool", "int": "Int32", "long": "Int64", "float": "Float32", "double": "Float64"}.get(a, "String"))


def create_table(spark: SparkSession, name: str, columns: str | S.StructType | None, structure_from: str | None, copy_from: str | None, options: CopyOptions, properties: dict[str, str], if_not_exists: bool = False) -> int:
    """Make a table whose columns are the file's (or those given), and with ``copy_from`` load the file. Returns the rows loaded.

    The types found are used for the load too, so a file is looked at once. If the load fails, the table goes again.
    """
    if structure_from and copy_from:
        raise ValueError('cannot combine option "structure_from" with option "copy_from"')
    if structure_from and columns:
        raise ValueError('option "structure_from" requires a table that names no columns')
    if if_not_exists:
        raise ValueError("IF NOT EXISTS is not supported with columns from a URL; drop it, or create the table first")
    if spark.catalog.tableExists(name):
        raise ValueError(f'relation "{name}" already exists')
    url, option = (structure_from, "structure_from") if structure_from else (copy_from, "copy_from")
    if url is None:
        raise ValueError("a table needs columns, structure_from or copy_from")
    try:
        locate(url, options)
    except ValueError as e:
        if str(e).startswith("cannot read URL"):
            raise ValueError(f'cannot read URL "{url}" specified by option "{option}"') from e
        raise
    found = None
    if columns:
        schema = catalog.parse_columns(columns) if isinstance(columns, str) else columns
    else:
        found = describe(spark, url, options)
        notices: list[str] = []
        schema = S.StructType([column_field(n, t, notices) for n, t in found])
        for notice in notices:
            log.warning(notice)
    catalog.create(spark, name, schema, properties)
    if not copy_from:
        return 0
    try:
        return copy.copy_from(spark, name, copy_from, options, structure=found)
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        raise
