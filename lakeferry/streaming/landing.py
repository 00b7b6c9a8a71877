"""A copy that goes on: files that land in a folder are appended to a table as they come, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lakeferry.operators import copy
from lakeferry.plans import catalog
from lakeferry.plans.options import CopyOptions
from lakeferry.sources import files


def copy_landing(spark: SparkSession, table: str, folder_url: str, options: CopyOptions, checkpoint: str, columns: list[str] | None = None) -> StreamingQuery:
    """Start the stream; it ends after what lies in the folder now, so that it can be run again for what comes later.

    A batch is written beside the checkpoint and its files are moved into the table under names made of the stream's and the batch's, those of an earlier try taken out first; then the batch
    is marked as done. So a batch that is tried again adds nothing twice. That wants a table of files without partition columns; others are refused.
    """
    arrived = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "[!._]*").load(folder_url).select("path")
    schema = catalog.table_schema(spark, table)
    r = copy.request(spark, schema, folder_url, options, columns)
    about = {row[0]: row[1] for row in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}
    if "# Partition Information" in about or "Location" not in about:
        raise ValueError(f'cannot land files in "{table}": it is partitioned, or has no folder')

    def load(batch: DataFrame, number: int) -> None:
        done = f"{checkpoint}/lakeferry/done-{number}"
        fs, mark = files.hadoop(spark, done)
        if fs.exists(mark):
            return
        paths = [row[0] for row in batch.select("path").collect()]  # names of the new files
        if paths:
            rows = copy.complete(copy.read_rows(spark, r, sorted(paths)), schema)
            place(rows.select(*[f"`{n}`" for n in spark.table(table).columns]), number)
        fs.create(mark, True).close()

    def place(rows: DataFrame, number: int) -> None:
        stage = f"{checkpoint}/lakeferry/batch-{number}"
        rows.write.mode("overwrite").format(about["Provider"]).save(stage)
        fs, folder = files.hadoop(spark, about["Location"])
        name = spark._jvm.org.apache.hadoop.fs.Path
        prefix = f"landed-{stream_name(checkpoint)}-{number}-"
        for old in fs.listStatus(folder):
            if old.getPath().getName().startswith(prefix):
                fs.delete(old.getPath(), False)
        staged_fs, staged = files.hadoop(spark, stage)
        for part in staged_fs.listStatus(staged):
            if part.getPath().getName().startswith("part-"):
                target = name(folder, prefix + part.getPath().getName())
                if not spark._jvm.org.apache.hadoop.fs.FileUtil.copy(staged_fs, part.getPath(), fs, target, True, spark._jsc.hadoopConfiguration()):
                    raise OSError(f"cannot move {part.getPath()} to {target}")
        files.drop(spark, stage)
        spark.catalog.refreshTable(table)

    return arrived.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_name(checkpoint: str) -> str:
    """A short name of the stream, by its checkpoint."""
    import zlib

    return f"{zlib.crc32(checkpoint.rstrip('/').encode()):08x}"
