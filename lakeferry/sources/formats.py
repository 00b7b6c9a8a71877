"""The registry of file formats: names, aliases and suffixes, and reading and writing by structure."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.pandas.types import to_arrow_schema

from lakeferry.functions.coerce import to_wire
from lakeferry.functions.text import interval_units, units_interval
from lakeferry.plans.options import CopyOptions, bare_name, codec_of
from lakeferry.runtime import scratch, ship
from lakeferry.sources import files
from lakeferry.sources.naming import places
from lakeferry.sources.binary import BINARY_FORMATS, avro_range_decode, codec_type, from_codec, to_codec
from lakeferry.sources.textual import TEXT_FORMATS
from lakeferry.sources.urls import Location, list_files
from lakeferry.types.grammar import FileType
from lakeferry.types.mapping import wire_type

Columns = list[tuple[str, FileType]]
SPARK_FORMATS = {"parquet", "orc"}
#: Fixed values.
ALIASES = {"tsv": "tabseparated", "tsvraw": "tabseparatedraw", "tsvwithnames": "tabseparatedwithnames", "tsvwithnamesandtypes": "tabseparatedwithnamesandtypes", "ndjson": "jsoneachrow", "jsonlines": "jsoneachrow"}
BY_SUFFIX = {"csv": "csv", "tsv": "tabseparated", "json": "json", "jsonl": "jsoneachrow", "ndjson": "jsoneachrow", "jsoncompact": "jsoncompact", "parquet": "parquet", "orc": "orc", "avro": "avro", "arrow": "arrow", "arrows": "arrowstream", "feather": "arrow", "native": "native", "msgpack": "msgpack", "bson": "bsoneachrow", "tskv": "tskv", "values": "values"}
#: Formats that can't carry any table: they want one column, an outside schema, or only go out.
REFUSED = {"jsonstrings", "template", "templateignorespaces", "lineasstring", "rawblob", "mysqldump", "rowbinarywithdefaults", "avroconfluent", "protobufsingle", "capnproto", "dwarf", "npy"}
_PARQUET_CODECS = {"none": "none", "gzip": "gzip", "zstd": "zstd", "lz4": "lz4", "snappy": "snappy", "auto": "zstd"}


def format_name(options: CopyOptions, path: str) -> str:
    name = options.format.lower()
    if name == "auto":
        suffix = bare_name(path).rsplit(".", 1)[-1].lower()
        if suffix not in BY_SUFFIX:
            raise ValueError(f'cannot tell the format of "{path}"')
        return BY_SUFFIX[suffix]
    name = ALIASES.get(name, name)
    if name in REFUSED:
        raise ValueError(f'format "{options.format}" cannot hold a table')
    if name not in TEXT_FORMATS and name not in BINARY_FORMATS and name not in SPARK_FORMATS:
        raise ValueError(f'unknown format "{options.format}"')
    return name


def write(df: DataFrame, location: Location, columns: Columns, options: CopyOptions, single_file: bool = True) -> None:
    """The rows of ``df``, whose columns are the structure's in order, at the location; what is there is replaced."""
    spark = df.sparkSession
    ship(spark)
    if location.kind == "http":
        staged = f"{_scratch(spark)}/{uuid.uuid4().hex}/{location.path.rsplit('/', 1)[-1]}"
        write(df, Location("file", staged, staged), columns, options)
        try:
            files.post(_qualified(spark, staged), location.address, int(location.conf["seconds"]))
        finally:
            files.drop(spark, staged.rpartition("/")[0])
        return
    name, target = format_name(options, location.path), location.path
    df = df.select(*[to_wire(F.col(f"`{f.name}`"), f.dataType, t).alias(n) for f, (n, t) in zip(df.schema.fields, columns, strict=True)])
    if name in SPARK_FORMATS:
        rows = df.select(*[_storable(F.col(f"`{n}`"), t).alias(n) for n, t in columns])
        codec = _PARQUET_CODECS[options.compression] if name == "parquet" else {"auto": "zstd"}.get(options.compression, options.compression)
        if not single_file:
            rows.write.mode("overwrite").option("compression", codec).format(name).save(target)
            return
        folder = files.staging_folder(spark, target)
        try:
            rows.coalesce(1).write.option("compression", codec).format(name).save(f"{folder}/rows")
            files.commit(spark, files.only_part(spark, f"{folder}/rows"), target)
        finally:
            files.drop(spark, folder)
        return
    codec = codec_of(target, options.compression)
    if name in TEXT_FORMATS:
        lines = TEXT_FORMATS[name].encode(df, columns)
        if not single_file:
            if TEXT_FORMATS[name].head or not name.endswith(("eachrow", "separated", "separatedraw", "csv", "tskv")) or name == "jsonobjecteachrow" or codec not in files.SPARK_CODECS:
                raise ValueError(f'format "{name}" with compression "{codec}" can be written to a single file only')
            lines.write.mode("overwrite").option("compression", files.SPARK_CODECS[codec]).text(target)
            return
        files.write_lines(lines, target, codec)
        return
    if not single_file:
        raise ValueError(f'format "{name}" can be written to a single file only')
    rows = df.select(*[to_codec(F.col(f"`{n}`"), t).alias(f"_{i}") for i, (n, t) in enumerate(columns)])
    encode, _ = BINARY_FORMATS[name]
    files.write_stream(rows, target, codec, encode(columns, to_arrow_schema(rows.schema)))


def _storable(c, t: FileType):
    return interval_units(c, t.plain.name[8:]) if t.plain.name.startswith("Interval") else c


def read(spark: SparkSession, location: Location, columns: Columns, options: CopyOptions, paths: list[str] | None = None) -> DataFrame:
    """The rows of all files at the location, in the types that hold the structure's.

    Columns are matched by name in formats that name them, in each file anew: what a file lacks is null, what else it has is passed by. In others they go by place.
    """
    ship(spark)
    paths = paths or list_files(spark, location)
    name = format_name(options, paths[0])
    if location.kind == "http":
        # fetched once, by a task for each file, so that all formats see plain files
        codec = codec_of(paths[0], options.compression) if name not in SPARK_FORMATS else "none"
        paths = files.convert(spark, paths, _qualified(spark, files.staging_folder(spark, f"{_scratch(spark)}/x")), codec, "none")
        options = replace(options, compression="none", format=name)
    if name in SPARK_FORMATS:
        got = spark.read.format(name).load(paths)
        if len(paths) > 1 and not {n for n, _ in columns} <= set(got.columns):
            got = spark.read.format(name).option("mergeSchema", "true").load(paths)  # another file may have what the first lacks
        at = places(got.columns, columns)
        have = [F.lit(None).cast(wire_type(t)) if i is None else _stored(F.col(f"`{n}`"), got.schema[n].dataType, t) for i, (n, t) in zip(at, columns, strict=True)]
        return got.select(*[c.alias(n) for c, (n, _) in zip(have, columns, strict=True)])
    codec = codec_of(paths[0], options.compression)
    if name in TEXT_FORMATS:
        known = codec in files.SPARK_CODECS and (codec == "none" or paths[0].lower().endswith(files.suffix_of(codec)))
        if not known:
            folder = _qualified(spark, files.staging_folder(spark, f"{_scratch(spark)}/x"))
            paths = files.convert(spark, paths, folder, codec, "none")
        return TEXT_FORMATS[name].decode(spark, paths, columns)
    kind = S.StructType([S.StructField(f"_{i}", codec_type(t)) for i, (_, t) in enumerate(columns)])
    _, decode = BINARY_FORMATS[name]
    if name == "avro" and codec == "none":
        rows = files.read_ranges(spark, paths, avro_range_decode(columns, to_arrow_schema(kind)), kind)
    else:
        rows = files.read_stream(spark, paths, codec, decode(columns, to_arrow_schema(kind)), kind)
    return rows.select(*[from_codec(F.col(f"_{i}"), t).alias(n) for i, (n, t) in enumerate(columns)])


def _qualified(spark: SparkSession, path: str) -> str:
    fs, p = files.hadoop(spark, path)
    return fs.makeQualified(p).toString()


def _scratch(spark: SparkSession) -> str:
    return scratch(spark) + "/unpacked"


def _stored(c, have: S.DataType, t: FileType):
    if t.plain.name.startswith("Interval"):
        return units_interval(c, t.plain.name[8:])
    want = wire_type(t)
    if have == want or isinstance(want, (S.ArrayType, S.MapType, S.StructType)):
        return c.cast(want) if have != want else c
    return to_wire(c, have, FileType("Nullable", (t,)) if not t.nullable else t)
