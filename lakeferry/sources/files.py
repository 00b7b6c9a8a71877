"""Files: staging and commit of a single output file, packing and unpacking, and streams that executors open themselves."""

from __future__ import annotations

import lzma
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Codecs that Spark's own text source writes and reads.
SPARK_CODECS = {"none": "none", "gzip": "gzip", "bz2": "bzip2", "snappy": "snappy"}
_SUFFIX = {"gzip": ".gz", "bz2": ".bz2", "snappy": ".snappy"}
CHUNK = 1 << 20
HTTP_SECONDS = 30


def filesystem(uri: str):
    """(pyarrow filesystem, path within it)"""
    import pyarrow.fs as fs

    uri = uri.replace("s3a://", "s3://", 1)
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri.replace(" ", "%20"))


def _open(uri: str):
    if uri.startswith(("http://", "https://")):
        return urllib.request.urlopen(uri, timeout=HTTP_SECONDS)
    fs, path = filesystem(uri)
    return fs.open_input_stream(path, compression=None)


def post(staged: str, url: str, seconds: int) -> None:
    """Send a staged file as the body of one request; it is streamed, not held."""
    with reading(staged) as body:
        size = filesystem(staged)[0].get_file_info(filesystem(staged)[1]).size
        request = urllib.request.Request(url, data=body, method="POST", headers={"Content-Length": str(size), "Content-Type": "application/octet-stream"})
        with urllib.request.urlopen(request, timeout=seconds) as answer:
            answer.read()


@contextmanager
def reading(uri: str, codec: str = "none") -> Iterator:
    with _open(uri) as raw:
        if codec == "none":
            yield raw
        elif codec == "xz":
            with lzma.open(raw) as stream:
                yield stream
        else:
            with pa.CompressedInputStream(raw, codec) as stream:
                yield stream


@contextmanager
def writing(uri: str, codec: str = "none") -> Iterator:
    fs, path = filesystem(uri)
    with fs.open_output_stream(path, compression=None) as raw:
        if codec == "none":
            yield raw
        elif codec == "xz":
            with lzma.open(raw, "wb") as stream:
                yield stream
        else:
            with pa.CompressedOutputStream(raw, codec) as stream:
                yield stream


def hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def staging_folder(spark: SparkSession, target: str) -> str:
    """A new folder beside the target, so that a rename is all the commit needs."""
    head, _, _ = target.rpartition("/")
    folder = f"{head}/.staging-{uuid.uuid4().hex}"
    fs, p = hadoop(spark, folder)
    fs.mkdirs(p)
    return folder


def commit(spark: SparkSession, staged: str, target: str) -> None:
    """Put the staged file in the target's place; whatever stood there goes."""
    fs, t = hadoop(spark, target)
    fs.mkdirs(t.getParent())
    if fs.exists(t):
        fs.delete(t, True)
    if not fs.rename(hadoop(spark, staged)[1], t):
        raise OSError(f"cannot move {staged} to {target}")


def drop(spark: SparkSession, path: str) -> None:
    fs, p = hadoop(spark, path)
    fs.delete(p, True)
    crc = spark._jvm.org.apache.hadoop.fs.Path(p.getParent(), "." + p.getName() + ".crc")
    if fs.exists(crc):
        fs.delete(crc, False)


def only_part(spark: SparkSession, folder: str) -> str:
    fs, p = hadoop(spark, folder)
    parts = sorted(s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().startswith("part-"))
    if len(parts) != 1:
        raise OSError(f"expected one part in {folder}, found {len(parts)}")
    return parts[0]


def write_lines(lines: DataFrame, target: str, codec: str) -> None:
    """One file of the ``value`` column's lines."""
    spark = lines.sparkSession
    folder = staging_folder(spark, target)
    try:
        lines.coalesce(1).write.option("compression", SPARK_CODECS.get(codec, "none")).text(f"{folder}/text")
        part = only_part(spark, f"{folder}/text")
        if codec not in SPARK_CODECS:
            part = convert(spark, [part], folder, "none", codec)[0]
        commit(spark, part, target)
    finally:
        drop(spark, folder)


def convert(spark: SparkSession, files: list[str], folder: str, source: str, codec: str) -> list[str]:
    """Copies of the files in ``folder``, from one codec to another, a task for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for uri in batch.column(0).to_pylist():
                name = f"{folder}/{uuid.uuid4().hex}"
                with reading(uri, source) as a, writing(name, codec) as b:
                    while chunk := a.read(CHUNK):
                        b.write(chunk)
                out.append((uri, name))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string())], ["source", "path"])

    named = paths(spark, files).mapInArrow(run, "source string, path string").collect()  # a row for each file
    found = {r[0]: r[1] for r in named}
    return [found[f] for f in files]


def paths(spark: SparkSession, files: list[str]) -> DataFrame:
    """A row for each file, each in a partition of its own."""
    return spark.createDataFrame([(f,) for f in files], "path string").repartition(len(files))


def write_stream(df: DataFrame, target: str, codec: str, encode: Callable) -> None:
    """One file of what ``encode(batches, stream)`` writes. An attempt writes a file of its own; the one whose task succeeds is committed."""
    spark = df.sparkSession
    folder = staging_folder(spark, target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/{uuid.uuid4().hex}"
        with writing(name, codec) as stream:
            encode(batches, stream)
        yield pa.RecordBatch.from_arrays([pa.array([name])], ["path"])

    try:
        done = df.coalesce(1).mapInArrow(run, "path string").collect()  # one row
        if not done:  # no partition at all
            name = f"{folder}/{uuid.uuid4().hex}"
            with writing(name, codec) as stream:
                encode(iter(()), stream)
            done = [(name,)]
        commit(spark, done[0][0], target)
    finally:
        drop(spark, folder)


def read_stream(spark: SparkSession, files: list[str], codec: str, decode: Callable, schema, named: bool = False) -> DataFrame:
    """Rows of the batches that ``decode(stream)`` yields, a task for each file; ``named``: it gets the file's name too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with reading(uri, codec) as stream:
                    yield from decode(stream, uri) if named else decode(stream)

    return paths(spark, files).mapInArrow(run, schema)


def read_ranges(spark: SparkSession, files: list[str], decode: Callable, schema) -> DataFrame:
    """Rows of the batches that ``decode(file, start, end)`` yields, ``file`` one that can be sought in: a task for each range, whose size is chosen as Spark does for its own sources."""
    sizes = [hadoop(spark, f)[0].getFileStatus(hadoop(spark, f)[1]).getLen() for f in files]
    step = max(4 << 20, -(-sum(sizes) // max(spark.sparkContext.defaultParallelism, 1)))
    step = min(step, int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))))
    ranges = [(f, at, min(at + step, n)) for f, n in zip(files, sizes, strict=True) for at in range(0, max(n, 1), step)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, path = filesystem(uri)
                with fs.open_input_file(path) as file:
                    yield from decode(file, start, end)

    return spark.createDataFrame(ranges, "path string, start long, end long").repartition(len(ranges)).mapInArrow(run, schema)


def suffix_of(codec: str) -> str:
    return _SUFFIX.get(codec, "")
