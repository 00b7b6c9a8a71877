from datetime import date, datetime, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lakeferry.sources.binary import BINARY_FORMATS
from lakeferry.sources.textual import TEXT_FORMATS

FORMATS = [*TEXT_FORMATS, *BINARY_FORMATS, "parquet", "orc"]
#: A field of a repeated kind can't be missing in a message, so nulls in arrays are lost.
NO_NULL_ITEMS = {"protobuf", "protobuflist"}


@pytest.fixture(scope="module")
def rows(spark):
    utc = lambda *a: datetime(*a, tzinfo=timezone.utc)
    data = [
        (1, -(1 << 63), 1.5, Decimal("12345.678900"), True, "plain", date(2024, 1, 15), utc(2024, 1, 15, 12, 34, 56, 789123), [1, 2], ("a", 1), {"k": 1}),
        (2, (1 << 63) - 1, float("inf"), Decimal("-0.000001"), False, "tab\tnew\nline\\back'quote\"double,comma", date(1969, 12, 30), utc(1969, 12, 30, 23, 59, 59, 999999), [], ("x'y", -2), {"a=b": 2, "c": 3}),
        (3, 0, float("nan"), None, None, "", None, None, [7], ("日本 🎉", 0), {}),
        (4, None, None, Decimal("0"), True, None, date(2299, 12, 31), utc(2299, 12, 31), [-1], ("", 9), {"": 0}),
    ]
    return spark.createDataFrame(data, "id int not null, b bigint, f double, d decimal(18,6), t boolean, s string, dt date, at timestamp, a array<int>, st struct<x:string,y:int>, m map<string,int>").cache()


def same(a, b):
    flat = lambda df: df.withColumn("m", F.array_sort(F.map_entries("m")))  # noqa: E731  (a map has no order)
    return flat(a).exceptAll(flat(b)).count() == 0 and flat(b).exceptAll(flat(a)).count() == 0


@pytest.mark.parametrize("format", FORMATS)
def test_every_format_gives_back_what_it_got(engine, folder, rows, format):
    url = f"{folder}/x"
    lone_lines = format in ("tabseparatedraw", "tabseparatedrawwithnames", "tabseparatedrawwithnamesandtypes")
    given = rows.filter("id <> 2") if lone_lines else rows  # raw text has no way to write a tab or a line's end
    assert engine.copy_to(given, url, format=format) == given.count()
    assert same(given, engine.read(url, schema=given.schema, format=format))


@pytest.mark.parametrize("format", [f for f in FORMATS if f not in NO_NULL_ITEMS])
def test_nulls_in_arrays(engine, folder, spark, format):
    given = spark.createDataFrame([(1, [None, 3]), (2, [None])], "id int, a array<int>")
    engine.copy_to(given, f"{folder}/x", format=format)
    assert sorted(map(tuple, engine.read(f"{folder}/x", schema=given.schema, format=format).collect())) == [(1, [None, 3]), (2, [None])]


@pytest.mark.parametrize("format", FORMATS)
def test_an_empty_table(engine, folder, rows, format):
    engine.copy_to(rows.filter("id < 0"), f"{folder}/x", format=format)
    assert engine.read(f"{folder}/x", schema=rows.schema, format=format).count() == 0


@pytest.mark.parametrize("suffix", [".gz", ".bz2", ".zst", ".xz", ".lz4", ".br", ".snappy"])
def test_codecs(engine, folder, spark, suffix):
    given = spark.range(100).selectExpr("id", "cast(id as string) s")
    engine.copy_to(given, f"{folder}/x.tsv{suffix}")
    assert engine.read(f"{folder}/x.tsv{suffix}", schema="id bigint, s text").exceptAll(given).count() == 0


def test_refused_formats(engine, folder, rows):
    for format in ("Npy", "Template", "nonsense"):
        with pytest.raises(ValueError):
            engine.copy_to(rows, f"{folder}/x", format=format)
