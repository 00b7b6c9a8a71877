"""Text formats: delimited, JSON in its many layouts, and value lists. All rows are made and read by column expressions."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from lakeferry.functions.text import escapable, escape, from_text, geo_as_nested, literal, nested, parse_cell, read_literal, scalar_text, text_type, unescape
from lakeferry.plans.options import codec_of
from lakeferry.runtime import materialize_columns, scratch
from lakeferry.sources.files import hadoop, read_stream, write_lines
from lakeferry.sources.naming import csv_names, heads, json_names, places
from lakeferry.sources.streams import batched, column_blocks, data_items, object_values, tuples
from lakeferry.types.grammar import FileType, parse_type, render_type
from lakeferry.types.mapping import GEO

Columns = list[tuple[str, FileType]]
NULL = "\\N"


@dataclass(frozen=True)
class TextFormat:
    """``encode``: rows to lines; ``decode``: files to rows; ``head``: lines of names and types before the rows."""

    encode: Callable[[DataFrame, Columns], DataFrame]
    decode: Callable[[SparkSession, list[str], Columns], DataFrame]
    head: int = 0


def _lines(spark: SparkSession, texts: list[str]) -> DataFrame:
    return spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1)


def _framed(rows: DataFrame, before: list[str], after: list[str] = (), comma: bool = False) -> DataFrame:
    """Lines with others before and after; with ``comma`` a comma leads all rows but the first."""
    if not before and not after and not comma:
        return rows
    spark = rows.sparkSession
    rows = rows.coalesce(1)
    if comma:
        rows = rows.select(F.when(F.monotonically_increasing_id() == 0, F.col("value")).otherwise(F.concat(F.lit(","), F.col("value"))).alias("value"))
    for text, first in ((before, True), (after, False)):
        if text:
            extra = _lines(spark, list(text))
            rows = extra.unionAll(rows) if first else rows.unionAll(extra)
    return rows


def _row(columns: Columns, one: Callable[[Column, FileType], Column]) -> list[Column]:
    return [F.coalesce(one(F.col(f"`{n}`"), t), F.lit(NULL)) for n, t in columns]


def _cell(c: Column, t: FileType) -> Column:
    return literal(c, t, within=False) if nested(t) else scalar_text(c, t.plain)


def _plain_escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n")


# tab-separated


def _tsv(head: int, raw: bool) -> TextFormat:
    def encode(df: DataFrame, columns: Columns) -> DataFrame:
        one = lambda c, t: escape(_cell(c, t)) if not raw and escapable(t) else _cell(c, t)
        rows = df.select(F.concat_ws("\t", *_row(columns, one)).alias("value"))
        name = (lambda s: s) if raw else _plain_escape
        names = ["\t".join(name(n) for n, _ in columns), "\t".join(name(render_type(t)) for _, t in columns)]
        return _framed(rows, names[:head])

    def decode(spark: SparkSession, files: list[str], columns: Columns) -> DataFrame:
        def rows(files: list[str], first: list[str], at: list[int | None]) -> DataFrame:
            lines = _dealt(spark, _without_head(spark.read.option("lineSep", "\n").text(files), first), files)
            lines = lines.select(F.split("value", "\t", -1).alias("p"))
            cell = lambda i, t: F.when(F.col("p")[i] != NULL, unescape(F.col("p")[i]) if not raw and escapable(t) else F.col("p")[i])
            return lines.select(*[parse_cell(_none() if i is None else cell(i, t), t).alias(n) for i, (n, t) in zip(at, columns, strict=True)])

        return _by_name(spark, files, columns, head, False, lambda line: [x if raw else _plain_unescape(x) for x in line.split("\t")], rows)

    return TextFormat(encode, decode, head)


def _none() -> Column:
    return F.lit(None).cast("string")


def _plain_unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"t": "\t", "n": "\n"}.get(m[1], m[1]), text, flags=re.S)


def _by_name(spark: SparkSession, files: list[str], columns: Columns, head: int, quoted: bool, names: Callable[[str], list[str]], rows: Callable) -> DataFrame:
    """``rows(files, their first lines, place of each wanted column)`` of files that begin alike; by place if the format names no columns."""
    if not head:
        return rows(files, [], list(range(len(columns))))
    found = heads(spark, files, head, quoted, lambda path: codec_of(path, "auto"))
    if not found:
        return rows(files[:1], [], list(range(len(columns)))).limit(0)
    return reduce(DataFrame.unionAll, [rows(own, first, places(names(first[0]), columns)) for own, first in found])


def _without_head(lines: DataFrame, firsts: list[str]) -> DataFrame:
    """All lines but the first of each file, which are ``firsts`` in all. Only lines like them, in a file's first block, are numbered; the others pass by."""
    if not firsts:
        return lines
    marked = lines.select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_s")).withColumn("_id", F.monotonically_increasing_id())
    suspect = F.col("value").isin(*firsts) & (F.col("_s") == 0)
    place = F.row_number().over(Window.partitionBy("_f", "value").orderBy("_id"))
    later = marked.filter(suspect).withColumn("_k", place).filter(F.col("_k") > (1 if len(set(firsts)) == len(firsts) else len(firsts)))
    return marked.filter(~suspect).select("value").unionAll(later.select("value"))


def head_lines(spark: SparkSession, file: str, head: int) -> list[str]:
    return [r[0] for r in spark.read.option("lineSep", "\n").text(file).limit(head).collect()]


# comma-separated


def _csv(head: int) -> TextFormat:
    def quoted(c: Column) -> Column:
        return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))

    def encode(df: DataFrame, columns: Columns) -> DataFrame:
        plain = ("Int", "UInt", "Float", "Decimal", "Bool", "BFloat", "Interval")
        one = lambda c, t: _cell(c, t) if t.plain.name.startswith(plain) else quoted(_cell(c, t))
        quote = lambda s: '"' + s.replace('"', '""') + '"'
        names = [",".join(quote(n) for n, _ in columns), ",".join(quote(render_type(t)) for _, t in columns)]
        return _framed(df.select(F.concat_ws(",", *_row(columns, one)).alias("value")), names[:head])

    def decode(spark: SparkSession, files: list[str], columns: Columns) -> DataFrame:
        def rows(files: list[str], first: list[str], at: list[int | None]) -> DataFrame:
            width = len(csv_names(first[0])) if first else len(columns)
            schema = S.StructType([S.StructField(f"_c{i}", S.StringType()) for i in range(width)])
            options = {"quote": '"', "escape": '"', "nullValue": NULL, "emptyValue": "", "enforceSchema": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
            read = spark.read.schema(schema).options(**options, header=head > 0, multiLine=_quoted_ends(spark, files)).csv(files)
            if len(first) > 1:
                types = csv_names(first[1])
                read = read.filter(~F.array(*[F.coalesce(F.col(f"_c{i}"), F.lit("")) for i in range(width)]).eqNullSafe(F.array(*[F.lit(t) for t in types])))
            return read.select(*[parse_cell(_none() if i is None else F.col(f"_c{i}"), t).alias(n) for i, (n, t) in zip(at, columns, strict=True)])

        return _by_name(spark, files, columns, head, True, csv_names, rows)

    return TextFormat(encode, decode, head)


#: Files that are no larger are read in one piece each, whatever they hold.
WHOLE_BYTES = 32 << 20


def _quoted_ends(spark: SparkSession, files: list[str]) -> bool:
    """Whether files must be read in one piece each, as some line may end within quotes: such a line has an odd number of them.

    It costs a pass over large files, in pieces, and lets them be parsed in pieces.
    """
    if max(hadoop(spark, f)[0].getFileStatus(hadoop(spark, f)[1]).getLen() for f in files[:64]) <= WHOLE_BYTES:
        return True
    odd = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(files).filter(odd % 2 == 1).limit(1).isEmpty()


def csv_head(spark: SparkSession, file: str, head: int) -> tuple[list[str], list[FileType]]:
    rows = spark.read.options(quote='"', escape='"', multiLine=True).csv(file).limit(head).collect()
    return list(rows[0]), [parse_type(x) for x in rows[1]] if head > 1 else []


# JSON


def json_ready(c: Column, t: FileType) -> Column:
    """A value as ``to_json`` should see it: instants as text in UTC, intervals as counts, bytes as text, keys of maps as text."""
    bare = t.plain
    if bare.name in GEO:
        bare = geo_as_nested(bare)
    if bare.name == "Array":
        return F.transform(c, lambda x: json_ready(x, bare.args[0]))
    if bare.name == "Nested":
        return F.transform(c, lambda x: json_ready(x, FileType("Tuple", bare.args, bare.fields)))
    if bare.name == "Tuple":
        names = bare.fields or [str(i + 1) for i in range(len(bare.args))]
        return F.when(c.isNotNull(), F.struct(*[json_ready(c[n], a).alias(n) for n, a in zip(names, bare.args, strict=True)]))
    if bare.name == "Map":
        return F.map_from_entries(F.transform(F.map_entries(c), lambda e: F.struct(scalar_text(e["key"], bare.args[0].plain).alias("key"), json_ready(e["value"], bare.args[1]).alias("value"))))
    if bare.name in ("DateTime", "DateTime64") or bare.name.startswith("Interval"):
        return scalar_text(c, bare)
    return c.cast("string") if bare.name in ("String", "FixedString") else c


_TO_JSON = {"ignoreNullFields": "false"}


def _object(columns: Columns) -> Column:
    return F.to_json(F.struct(*[json_ready(F.col(f"`{n}`"), t).alias(n) for n, t in columns]), _TO_JSON)


def _json_value(c: Column, t: FileType) -> Column:
    text = F.to_json(F.struct(json_ready(c, t).alias("v")), _TO_JSON)
    return F.substring(text, 6, 1 << 30).substr(F.lit(1), F.length(text) - 6)


def _json_strings(c: Column, t: FileType) -> Column:
    text = F.to_json(F.struct(_cell(c, t).alias("v")), _TO_JSON)
    return F.substring(text, 6, 1 << 30).substr(F.lit(1), F.length(text) - 6)


def json_text_type(t: FileType) -> S.DataType:
    """As ``text_type``, with maps as maps of text keys."""
    t = t.plain
    if t.name in GEO:
        t = geo_as_nested(t)
    if t.name == "Array":
        return S.ArrayType(json_text_type(t.args[0]))
    if t.name == "Map":
        return S.MapType(S.StringType(), json_text_type(t.args[1]))
    if t.name in ("Tuple", "Nested"):
        names = t.fields or [str(i + 1) for i in range(len(t.args))]
        of = S.StructType([S.StructField(n, json_text_type(a)) for n, a in zip(names, t.args, strict=True)])
        return S.ArrayType(of) if t.name == "Nested" else of
    return S.StringType()


def from_json_text(c: Column, t: FileType) -> Column:
    bare = t.plain
    if bare.name in GEO:
        bare = geo_as_nested(bare)
    if bare.name == "Array":
        return F.transform(c, lambda x: from_json_text(x, bare.args[0]))
    if bare.name == "Nested":
        return F.transform(c, lambda x: from_json_text(x, FileType("Tuple", bare.args, bare.fields)))
    if bare.name == "Tuple":
        names = bare.fields or [str(i + 1) for i in range(len(bare.args))]
        return F.when(c.isNotNull(), F.struct(*[from_json_text(c[n], a).alias(n) for n, a in zip(names, bare.args, strict=True)]))
    if bare.name == "Map":
        return F.map_from_entries(F.transform(F.map_entries(c), lambda e: F.struct(from_text(e["key"], bare.args[0]).alias("key"), from_json_text(e["value"], bare.args[1]).alias("value"))))
    return from_text(c, bare)


def _from_object(rows: DataFrame, columns: Columns, strings: bool = False) -> DataFrame:
    """Rows of the ``value`` column's objects."""
    kind = S.StructType([S.StructField(n, S.StringType() if strings else json_text_type(t)) for n, t in columns])
    rows = rows.select(F.from_json("value", kind, {"mode": "FAILFAST"}).alias("o"))
    pick = parse_cell if strings else from_json_text
    return rows.select(*[pick(F.col("o")[n], t).alias(n) for n, t in columns])


def _from_array(rows: DataFrame, columns: Columns, strings: bool = False, at: list[int | None] | None = None) -> DataFrame:
    rows = rows.select(F.from_json("value", "array<string>", {"mode": "FAILFAST"}).alias("a"))
    at = list(range(len(columns))) if at is None else at
    return rows.select(*[_element(_none() if i is None else F.col("a")[i], t, strings).alias(n) for i, (n, t) in zip(at, columns, strict=True)])


def _element(c: Column, t: FileType, strings: bool = False) -> Column:
    if strings:
        return parse_cell(c, t)
    return from_json_text(F.from_json(c, json_text_type(t)) if nested(t) else c, t)


def _items(spark: SparkSession, files: list[str], items: Callable) -> DataFrame:
    """The ``value`` rows that a file lists, as it is read, a task for each file; Spark deals them out again before they are parsed."""
    parts = [read_stream(spark, own, codec, batched(items), "value string") for codec, own in _by_codec(files).items()]
    return reduce(DataFrame.unionAll, parts).repartition(max(spark.sparkContext.defaultParallelism, 1)) if len(files) < spark.sparkContext.defaultParallelism else reduce(DataFrame.unionAll, parts)


def _streamable(spark: SparkSession, files: list[str], codec: str) -> list[str]:
    """The files, or unpacked copies where only Spark can unpack them. Their lines end alike then, which no value can hold."""
    if codec != "snappy":
        return files
    to = [f"{scratch(spark)}/unpacked/{uuid.uuid4().hex}/x" for _ in files]
    for f, name in zip(files, to, strict=True):
        write_lines(spark.read.text(f), name, "none")
    return [hadoop(spark, name)[0].makeQualified(hadoop(spark, name)[1]).toString() for name in to]


def _by_codec(files: list[str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for f in files:
        out.setdefault(codec_of(f, "auto"), []).append(f)
    return out


#: Compressed files that are larger are dealt out by lines before they are parsed, as one task must unpack them whole.
PACKED_BYTES = 8 << 20


def _dealt(spark: SparkSession, lines: DataFrame, files: list[str]) -> DataFrame:
    """``lines`` of few packed files over all tasks, so that only unpacking is one file's task."""
    tasks = spark.sparkContext.defaultParallelism
    if len(files) >= tasks or codec_of(files[0], "auto") not in ("gzip", "snappy"):
        return lines
    largest = max(hadoop(spark, f)[0].getFileStatus(hadoop(spark, f)[1]).getLen() for f in files)
    return lines.repartition(tasks) if largest > PACKED_BYTES else lines


def _each_row(strings: bool) -> TextFormat:
    def encode(df: DataFrame, columns: Columns) -> DataFrame:
        if not strings:
            return df.select(_object(columns).alias("value"))
        return df.select(F.to_json(F.struct(*[_cell(F.col(f"`{n}`"), t).alias(n) for n, t in columns]), _TO_JSON).alias("value"))

    return TextFormat(encode, lambda spark, files, columns: _from_object(_dealt(spark, spark.read.text(files).filter("value <> ''"), files), columns, strings))


def _compact_each_row(strings: bool, head: int) -> TextFormat:
    def encode(df: DataFrame, columns: Columns) -> DataFrame:
        one = _json_strings if strings else _json_value
        rows = df.select(F.concat(F.lit("["), F.concat_ws(",", *[one(F.col(f"`{n}`"), t) for n, t in columns]), F.lit("]")).alias("value"))
        names = [json.dumps([n for n, _ in columns], ensure_ascii=False), json.dumps([render_type(t) for _, t in columns], ensure_ascii=False)]
        return _framed(rows, names[:head])

    def decode(spark: SparkSession, files: list[str], columns: Columns) -> DataFrame:
        rows = lambda files, first, at: _from_array(_without_head(spark.read.text(files), first), columns, strings, at)
        return _by_name(spark, files, columns, head, False, json_names, rows)

    return TextFormat(encode, decode, head)


def _meta(columns: Columns) -> str:
    return json.dumps([{"name": n, "type": render_type(t)} for n, t in columns], ensure_ascii=False)


def _document(compact: bool) -> TextFormat:
    def encode(df: DataFrame, columns: Columns) -> DataFrame:
        value = F.concat(F.lit("["), F.concat_ws(",", *[_json_value(F.col(f"`{n}`"), t) for n, t in columns]), F.lit("]")) if compact else _object(columns)
        return _framed(df.select(value.alias("value")), ['{"meta":' + _meta(columns) + ',"data":['], ["]}"], comma=True)

    def decode(spark: SparkSession, files: list[str], columns: Columns) -> DataFrame:
        rows = _items(spark, files, data_items)
        return (_from_array if compact else _from_object)(rows, columns)

    return TextFormat(encode, decode)


def _columnar(layout: str) -> TextFormat:
    def encode(df: DataFrame, columns: Columns) -> DataFrame:
        # a column after the other, a line for each value; the rows are written first, so that all columns see them in one order
        values = materialize_columns(df.select(*[_json_value(F.col(f"`{n}`"), t).alias(f"_{i}") for i, (n, t) in enumerate(columns)]))
        begin, end = {"compact": ("[", "]"), "plain": ("{", "}"), "meta": ('{"meta":' + _meta(columns) + ',"data":{', "}}")}[layout]
        lines = None
        for i, (n, _) in enumerate(columns):
            key = "" if layout == "compact" else json.dumps(n, ensure_ascii=False) + ":"
            part = _framed(values[i], [("," if i else begin) + key + "["], ["]" + (end if i == len(columns) - 1 else "")], comma=True)
            lines = part if lines is None else lines.unionAll(part)
        return lines

    def decode(spark: SparkSession, files: list[str], columns: Columns) -> DataFrame:
        # a file's columns are read one after the other, in blocks of rows; those of the same rows then meet
        names, schema = [n for n, _ in columns], "file string, block long, at int, items string"
        parts = [read_stream(spark, _streamable(spark, own, codec), codec if codec != "snappy" else "none", column_blocks(layout, names), schema, named=True) for codec, own in _by_codec(files).items()]
        blocks = reduce(DataFrame.unionAll, parts).repartition("file", "block")
        blocks = blocks.groupBy("file", "block").agg(*[F.max(F.when(F.col("at") == i, F.col("items"))).alias(f"_{i}") for i in range(len(columns))])
        lists = [F.from_json(F.coalesce(f"_{i}", F.lit("[]")), "array<string>", {"mode": "FAILFAST"}).alias(f"_{i}") for i in range(len(columns))]
        rows = blocks.select(*lists).select(F.explode(F.arrays_zip(*[f"_{i}" for i in range(len(columns))])).alias("r"))
        return rows.select(*[_element(F.col("r")[f"_{i}"], t).alias(n) for i, (n, t) in enumerate(columns)])

    return TextFormat(encode, decode)


def _object_each_row() -> TextFormat:
    def encode(df: DataFrame, columns: Columns) -> DataFrame:
        rows = df.coalesce(1).select(F.concat(F.lit('"row_'), (F.monotonically_increasing_id() + 1).cast("string"), F.lit('":'), _object(columns)).alias("value"))
        return _framed(rows, ["{"], ["}"], comma=True)

    def decode(spark: SparkSession, files: list[str], columns: Columns) -> DataFrame:
        return _from_object(_items(spark, files, object_values), columns)

    return TextFormat(encode, decode)


# others


def _tskv() -> TextFormat:
    def encode(df: DataFrame, columns: Columns) -> DataFrame:
        cells = _row(columns, lambda c, t: escape(_cell(c, t)))
        return df.select(F.concat_ws("\t", *[F.concat(F.lit(_plain_escape(n).replace("=", "\\=") + "="), c) for (n, _), c in zip(columns, cells, strict=True)]).alias("value"))

    def decode(spark: SparkSession, files: list[str], columns: Columns) -> DataFrame:
        pair = lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.substring(p, F.instr(p, "=") + 1, F.length(p)).alias("v"))
        rows = spark.read.option("lineSep", "\n").text(files).select(F.map_from_entries(F.transform(F.split("value", "\t", -1), pair)).alias("m"))
        cell = lambda n: F.when(F.col("m")[n] != NULL, unescape(F.col("m")[n]))
        return rows.select(*[parse_cell(cell(_plain_escape(n)), t).alias(n) for n, t in columns])

    return TextFormat(encode, decode)


def _values() -> TextFormat:
    def encode(df: DataFrame, columns: Columns) -> DataFrame:
        row = F.concat(F.lit("("), F.concat_ws(",", *[literal(F.col(f"`{n}`"), t) for n, t in columns]), F.lit(")"))
        return _framed(df.select(row.alias("value")), [], comma=True)

    def decode(spark: SparkSession, files: list[str], columns: Columns) -> DataFrame:
        row = FileType("Tuple", tuple(t for _, t in columns), tuple(f"_{i}" for i in range(len(columns))))

        def split(texts: pd.Series) -> pd.Series:
            return texts.map(lambda x: json.dumps(read_literal(x, row)))

        rows = _items(spark, files, tuples).select(F.from_json(F.pandas_udf(split, "string")(F.col("value")), text_type(row)).alias("r"))
        return rows.select(*[from_text(F.col("r")[f"_{i}"], t).alias(n) for i, (n, t) in enumerate(columns)])

    return TextFormat(encode, decode)


#: By lower-case name.
TEXT_FORMATS: dict[str, TextFormat] = {
    "tabseparated": _tsv(0, False), "tabseparatedraw": _tsv(0, True), "tabseparatedwithnames": _tsv(1, False), "tabseparatedwithnamesandtypes": _tsv(2, False),
    "tabseparatedrawwithnames": _tsv(1, True), "tabseparatedrawwithnamesandtypes": _tsv(2, True),
    "csv": _csv(0), "csvwithnames": _csv(1), "csvwithnamesandtypes": _csv(2),
    "customseparated": _tsv(0, False), "customseparatedwithnames": _tsv(1, False), "customseparatedwithnamesandtypes": _tsv(2, False),
    "values": _values(), "tskv": _tskv(),
    "json": _document(False), "jsoncompact": _document(True), "jsoncolumns": _columnar("plain"), "jsoncolumnswithmetadata": _columnar("meta"), "jsoncompactcolumns": _columnar("compact"),
    "jsoneachrow": _each_row(False), "jsonstringseachrow": _each_row(True), "jsonobjecteachrow": _object_each_row(),
    "jsoncompacteachrow": _compact_each_row(False, 0), "jsoncompacteachrowwithnames": _compact_each_row(False, 1), "jsoncompacteachrowwithnamesandtypes": _compact_each_row(False, 2),
    "jsoncompactstringseachrow": _compact_each_row(True, 0), "jsoncompactstringseachrowwithnames": _compact_each_row(True, 1), "jsoncompactstringseachrowwithnamesandtypes": _compact_each_row(True, 2),
}
