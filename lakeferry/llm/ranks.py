"""Places of values in their order, without one task seeing all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeferry.runtime import materialize


def ranked(values: DataFrame, name: str) -> DataFrame:
    """``values`` with ``_place``, from 0, in the order of the column ``name``, nulls last. Rows should differ in it.

    Values are dealt out by ranges; a row's place is that in its range plus the rows of the ranges before. Only the ranges' counts, a number for each partition, are in one task.
    """
    order = F.col(name).asc_nulls_last()
    ranges = materialize(values.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return ranges.join(before, "_range").withColumn("_place", F.col("_before") + place).drop("_range", "_before")
