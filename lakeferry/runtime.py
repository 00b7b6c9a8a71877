"""Session helpers: shipping the package to executors and writing intermediate tables to the cluster's shared folder."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED, _SCRATCH = "_lakeferry_shipped", "_lakeferry_scratch"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of an Arrow batch that a Python worker is sent, in place of Spark's 64 MB, so that its memory follows this and not 10,000 rows.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
#: Of local folders: where Hadoop has no native library it starts a process (chmod) for each folder and file that it makes, and its checksummed file system one more for the sums.
#: Until such a process has its own program it shares the executor's memory, and who adds up by process counts that twice.
_PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def ship(spark: SparkSession) -> None:
    """Give executors this package once per application, by Spark's own file service, so that functions can be sent by reference.

    Batches sent to Python are bounded in bytes, unless the session has a bound of its own.
    """
    context = spark.sparkContext
    if spark.conf.get(_BATCH, "67108864b") == "67108864b":
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    if getattr(context, _SHIPPED, False):
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="lakeferry-"), "lakeferry.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent).as_posix())
    context.addPyFile(archive)
    setattr(context, _SHIPPED, True)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only a driver that is its own executor may do without: others see no folder of its machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not folder:
        folder = getattr(spark.sparkContext, "_lakeferry_folder", None) or "file://" + tempfile.mkdtemp(prefix="lakeferry-shared-")
        spark.sparkContext._lakeferry_folder = folder
    return folder.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """This application's own folder in the shared one. It goes when the driver's Python ends in order."""
    context = spark.sparkContext
    folder = f"{shared_folder(spark)}/lakeferry-{context.applicationId}"
    if getattr(context, _SCRATCH, None) != folder:
        setattr(context, _SCRATCH, folder)
        atexit.register(_remove, spark._jvm, spark._jsc.hadoopConfiguration(), folder)
    return folder


def _remove(jvm, conf, folder: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone by now
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def materialize(df: DataFrame, name: str = "t", plain: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation.

    What was shuffled for it is of no more use then, and goes as soon as the write has ended. ``plain``: without files of checksums.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.options(**(_PLAIN_FILES if plain else {})).parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def materialize_columns(df: DataFrame, name: str = "columns") -> list[DataFrame]:
    """Write the texts of each column, which hold no line end, to a file of lines, and read them back as ``value``, all columns in one order of rows.

    One task writes all files in one pass and the lines are read one by one, so that rows of any width take the memory of a few rows.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    lines = df.coalesce(1).select(F.posexplode(F.array(*[F.col(f"`{c}`") for c in df.columns])).alias("at", "value"))
    # with as many open files as columns rows aren't sorted by column before
    held = {_CLEAN: "true", "spark.sql.maxConcurrentOutputFileWriters": str(len(df.columns) + 1)}
    before = {k: spark.conf.get(k, "false" if k == _CLEAN else "0") for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        lines.write.partitionBy("at").options(maxRecordsPerFile=0, lineSep="\n", compression="none").text(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    folders = [f"{path}/at={i}" for i in range(len(df.columns))]
    first = spark._jvm.org.apache.hadoop.fs.Path(folders[0])
    if not first.getFileSystem(spark._jsc.hadoopConfiguration()).exists(first):  # no rows
        return [spark.createDataFrame([], "value string") for _ in folders]
    return [spark.read.option("lineSep", "\n").text(f) for f in folders]
