"""Copies between tables and files."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from lakeferry.functions.coerce import to_column
from lakeferry.plans import catalog
from lakeferry.plans.options import CopyOptions
from lakeferry.runtime import materialize
from lakeferry.sources import files, formats
from lakeferry.sources.urls import Location, list_files, locate, scheme_of
from lakeferry.types.grammar import FileType, check_structure
from lakeferry.types.mapping import structure_of

log = logging.getLogger("lakeferry")


@dataclass(frozen=True)
class Request:
    location: Location
    options: CopyOptions
    schema: S.StructType
    structure: list[tuple[str, FileType]]


def request(spark: SparkSession, schema: S.StructType, url: str, options: CopyOptions, columns: list[str] | None) -> Request:
    """What a copy moves: the listed columns (all by default) and the structure that the file has of them."""
    if scheme_of(url) is None:
        raise ValueError(f'cannot copy with URL "{url}"')
    known = {f.name: f for f in schema.fields}
    for c in columns or []:
        if c not in known:
            raise ValueError(f'column "{c}" does not exist')
    if columns and len(set(columns)) < len(columns):
        raise ValueError("a column is listed more than once")
    picked = S.StructType([known[c] for c in columns] if columns else [f for f in schema.fields if not (f.metadata or {}).get("generated")])
    location = locate(url, options)
    if options.structure:
        structure = check_structure(options.structure, len(picked.fields))
    else:
        structure = structure_of(picked, "" if options.format == "auto" else options.format)
    for key, value in location.conf.items():
        if key.startswith("fs.") and value is None:
            spark._jsc.hadoopConfiguration().unset(key)
        elif key.startswith("fs."):
            spark._jsc.hadoopConfiguration().set(key, value)
    log.debug("copy %s as %s, %s", location.address.partition("?")[0], structure, options.redacted())
    return Request(location, options, picked, structure)


def copy_to(df: DataFrame, url: str, options: CopyOptions, columns: list[str] | None = None, schema: S.StructType | None = None, single_file: bool = True) -> int:
    """Write the rows to the file that the URL names, in place of what it holds; returns how many they were."""
    if columns is None and schema is None:
        schema = df.schema
    schema = schema or df.schema
    r = request(df.sparkSession, schema, url, options, columns)
    seen = Observation()
    rows = df.select(*[F.col(f"`{f.name}`") for f in r.schema.fields]).observe(seen, F.count(F.lit(1)).alias("n"))
    formats.write(rows, r.location, r.structure, options, single_file)
    return int(seen.get["n"] or 0)


def read_rows(spark: SparkSession, r: Request, paths: list[str] | None = None) -> DataFrame:
    """The file's rows as the listed columns of the table."""
    got = formats.read(spark, r.location, r.structure, r.options, paths)
    return got.select(*[to_column(F.col(f"`{n}`"), t, f, r.options.encoding_check).alias(f.name) for (n, t), f in zip(r.structure, r.schema.fields, strict=True)])


def complete(rows: DataFrame, schema: S.StructType) -> DataFrame:
    """All of the table's columns: unlisted ones by their defaults, then generated ones, then what must hold is held against each row."""
    have = set(rows.columns)
    for f in schema.fields:
        meta = f.metadata or {}
        if f.name not in have and not meta.get("generated"):
            value = F.expr(meta["default"]) if meta.get("default") else F.lit(None)
            rows = rows.withColumn(f.name, value.cast(f.dataType))
    for f in schema.fields:
        if (f.metadata or {}).get("generated"):
            rows = rows.withColumn(f.name, F.expr(f.metadata["generated"]).cast(f.dataType))
    checked = catalog.constrained({f.name: F.col(f"`{f.name}`") for f in schema.fields}, schema)
    rows = rows.select(*[c.alias(n) for n, c in checked.items()])
    for text in catalog.checks(schema):
        broken = F.raise_error(F.lit(f"new row violates check constraint ({text})")).cast("boolean")
        rows = rows.filter(F.when(F.coalesce(F.expr(text), F.lit(True)), True).otherwise(broken))
    return rows


def copy_from(spark: SparkSession, table: str, url: str, options: CopyOptions, columns: list[str] | None = None, structure: list[tuple[str, FileType]] | None = None, unique: list[str] | None = None, threads: int = 0) -> int:
    """Append the rows of the files that the URL names to the table; all of them, or none if one is refused. Returns how many they were.

    ``unique``: columns whose values together no two rows may share, besides those that the table declares unique; nulls are like nothing. ``threads``: tasks that read and write at a time, at most; 0 for what the cluster has.
    """
    schema = catalog.table_schema(spark, table)
    r = request(spark, schema, url, options, columns)
    if structure:
        r = Request(r.location, r.options, r.schema, structure)
    seen = Observation()
    rows = complete(read_rows(spark, r), schema)
    rows = rows.coalesce(threads) if threads else rows
    keys = ([list(unique)] if unique else []) + [k for k in catalog.unique_keys(schema) if k != unique]
    if keys:
        rows = materialize(rows, "copy")
    for key in keys:
        # only the new rows' keys are grouped; the table's meet them by a join
        new = rows.select(*key).dropna().groupBy(*key).count()
        old = spark.table(table).select(*key).dropna().join(new.select(*key), key, "left_semi")
        if new.filter("count > 1").limit(1).count() or old.limit(1).count():
            raise ValueError(f"duplicate key value violates unique constraint ({', '.join(key)})")
    rows = rows.observe(seen, F.count(F.lit(1)).alias("n"))
    rows.select(*[f"`{n}`" for n in spark.table(table).columns]).write.insertInto(table)
    return int(seen.get["n"] or 0)


def copy_into_parts(spark: SparkSession, parts: dict[str, str], url: str, options: CopyOptions, columns: list[str] | None = None) -> int:
    """Route rows to the table whose predicate holds for them; a row for which none does raises before anything is written."""
    first = next(iter(parts))
    schema = catalog.table_schema(spark, first)
    rows = materialize(complete(read_rows(spark, request(spark, schema, url, options, columns)), schema), "routed")
    fits, own = F.lit(False), {}
    for table, predicate in parts.items():
        holds = F.coalesce(F.expr(predicate), F.lit(False))
        own[table], fits = holds & ~fits, fits | holds  # of predicates that overlap the first takes the row
    if rows.filter(~fits).limit(1).count():
        raise ValueError("no partition of relation found for row")
    before: dict[str, set[str]] = {}
    try:
        for table, mine in own.items():
            before[table] = set(spark.table(table).inputFiles())
            rows.filter(mine).write.insertInto(table)
    except Exception:
        # what was written so far goes again, so that all parts are loaded or none
        for table, had in before.items():
            spark.catalog.refreshTable(table)
            for path in set(spark.table(table).inputFiles()) - had:
                files.drop(spark, path)
            spark.catalog.refreshTable(table)
        raise
    return rows.count()


def files_at(spark: SparkSession, url: str, options: CopyOptions) -> list[str]:
    return list_files(spark, locate(url, options))
