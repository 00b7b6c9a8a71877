"""Readers in pieces: ranges of Avro files, documents and value lists as they are read, headers by file, comma-separated files in pieces."""

import io
import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.pandas.types import to_arrow_schema

from lakeferry.functions.text import brain_float
from lakeferry.plans import catalog
from lakeferry.sources import binary, naming, streams, textual
from lakeferry.streaming.landing import copy_landing
from lakeferry.plans.options import copy_options
from lakeferry.types.grammar import parse_structure

VALUES = ["plain", 'quo"te', "back\\slash", "it's", "(", "[1,", "é😀", "", "a,b\nc", -12.5, 0, 10**18, True, None, [1, "]"], {"k": "}"}]


@pytest.mark.parametrize("chunk", [1, 3, 7, 1 << 18])
def test_documents_are_read_piece_by_piece(chunk, monkeypatch):
    monkeypatch.setattr(streams, "CHUNK", chunk)
    rng = random.Random(1)
    for _ in range(25):
        rows = [{f"c{i}": rng.choice(VALUES) for i in range(3)} for _ in range(rng.choice([0, 1, 6]))]
        for indent in (None, 1):
            text = json.dumps({"meta": [{"name": "data"}], "rows": len(rows), "data": rows, "n": 1}, indent=indent, ensure_ascii=False)
            assert [json.loads(x) for x in streams.data_items(io.BytesIO(text.encode()))] == rows
            text = json.dumps({f"row_{i}": r for i, r in enumerate(rows)}, indent=indent)
            assert [json.loads(x) for x in streams.object_values(io.BytesIO(("﻿" + text).encode()))] == rows
    with pytest.raises(ValueError):
        list(streams.data_items(io.BytesIO(b'{"data": [{"a": 1}, {"a"')))
    numbers = "[" + ",".join(map(str, range(300))) + "]"
    assert list(streams.data_items(io.BytesIO(b'{"data":' + numbers.encode() + b"}"))) == [str(i) for i in range(300)]


@pytest.mark.parametrize("chunk", [1, 2, 5, 1 << 18])
def test_value_lists_are_read_piece_by_piece(chunk, monkeypatch):
    monkeypatch.setattr(streams, "CHUNK", chunk)
    rows = ["(1,'a')", "(2,'it''s (')", "(3,'\\'),(')", "([1,(2)],{'k':'}'})", "('','''')", "(NULL)"]
    for joined in (",".join(rows), " ,\n".join(rows) + ";\n", "".join(rows)):
        assert list(streams.tuples(io.BytesIO(joined.encode()))) == rows
    for bad in ("(1,'a", "1,2", "(1,(2)"):
        with pytest.raises(ValueError):
            list(streams.tuples(io.BytesIO(bad.encode())))


@pytest.mark.parametrize("nested", [False, True])
def test_avro_ranges_have_each_block_once(nested):
    columns = parse_structure("a Int64, b Nullable(String), c Nullable(Float64), d Bool" + (", e Array(Int32)" if nested else ""))
    schema = to_arrow_schema(S.StructType([S.StructField(n, binary.codec_type(t)) for n, t in columns]))
    rng = random.Random(2)
    rows = [(rng.choice([0, -1, 63, 64, -65, 1 << 40, -(1 << 62)]), rng.choice([None, b"", "é".encode() * 200, b"x"]), rng.choice([None, 1.5, -0.0]), rng.random() < 0.5, *([[1, 2]] if nested else [])) for _ in range(900)]
    cells = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
    out = io.BytesIO()
    batch = pa.RecordBatch.from_arrays(cells, schema=schema)
    binary.avro_encode(columns, schema)([batch.slice(i, 37) for i in range(0, 900, 37)], out)
    data = out.getvalue()
    whole = [r for b in binary.avro_decode(columns, schema)(io.BytesIO(data)) for r in zip(*b.to_pydict().values(), strict=True)]
    assert whole == rows
    for step in (50, 333, 4096, len(data)):
        read = binary.avro_range_decode(columns, schema)
        got = [r for at in range(0, len(data), step) for b in read(io.BytesIO(data), at, min(at + step, len(data))) for r in zip(*b.to_pydict().values(), strict=True)]
        assert got == rows
    swapped = [columns[2], columns[0]]
    part = to_arrow_schema(S.StructType([S.StructField(n, binary.codec_type(t)) for n, t in swapped]))
    assert [r for b in binary.avro_decode(swapped, part)(io.BytesIO(data)) for r in zip(*b.to_pydict().values(), strict=True)] == [(r[2], r[0]) for r in rows]


def test_first_records(tmp_path):
    path = tmp_path / "x.csv"
    path.write_bytes(b'"a\nb",c\r\n1,"2\n\n"\n3,4')
    uri = f"file://{path}"
    assert naming.first_records(uri, "none", 2, True) == ['"a\nb",c\r', '1,"2\n\n"']
    assert naming.first_records(uri, "none", 9, True) == ['"a\nb",c\r', '1,"2\n\n"', "3,4"]
    assert naming.first_records(uri, "none", 1, False) == ['"a']
    path.write_bytes(b"")
    assert naming.first_records(uri, "none", 1, True) == []


@pytest.mark.parametrize("here", [16, 0])
def test_headers_are_those_of_each_file(spark, engine, folder, tmp_path, here, monkeypatch):
    monkeypatch.setattr(naming, "HERE", here)
    (tmp_path / "a.tsv").write_text("id\tn\n1\tx\nID\tN\n")
    (tmp_path / "b.tsv").write_text("n\tmore\tid\ny\t0\t2\nid\tn\t3\n")
    (tmp_path / "c.tsv").write_text("")
    got = engine.read(f"{folder}/*.tsv", "id text, n text", format="TSVWithNames").collect()
    assert sorted(map(tuple, got)) == [("1", "x"), ("2", "y"), ("3", "id"), ("ID", "N")]
    (tmp_path / "d.tsv").write_text("p\tq\n1\t2\n")
    with pytest.raises(ValueError, match="has none of the columns id, n; it has p, q"):
        engine.read(f"{folder}/d.tsv", "id text, n text", format="TSVWithNames")


@pytest.mark.parametrize("text, whole", [('1,"a"\n2,"b ""c"""\n', False), ('1,"a\nb"\n2,"c"\n', True)])
def test_large_csv_is_read_in_pieces_unless_lines_end_in_quotes(spark, engine, folder, tmp_path, text, whole, monkeypatch):
    monkeypatch.setattr(textual, "WHOLE_BYTES", 0)
    (tmp_path / "x.csv").write_text(text * 50)
    assert textual._quoted_ends(spark, [f"{folder}/x.csv"]) == whole
    assert sorted(r.s for r in engine.read(f"{folder}/x.csv", "i int, s text", format="CSV").collect()) == sorted((["a\nb", "c"] if whole else ["a", 'b "c"']) * 50)


def test_columns_are_told_from_the_head(spark, engine, folder, tmp_path, monkeypatch):
    from lakeferry.operators import create

    monkeypatch.setattr(create, "HEAD_ROWS", 20)
    (tmp_path / "x.csv").write_text("".join(f'{i},"l\n{i}"\n' for i in range(100)) + "word,x\n")
    assert engine.describe(f"{folder}/x.csv") == [("c1", "Nullable(Int64)"), ("c2", "Nullable(String)")]
    (tmp_path / "x.jsonl").write_text("".join(f'{{"a": {i}}}\n' for i in range(100)) + '{"b": 1}\n')
    assert [n for n, _ in engine.describe(f"{folder}/x.jsonl")] == ["a"]


def test_a_batch_that_is_tried_again_lands_once(spark, engine, folder, tmp_path):
    catalog.create(spark, "landed", catalog.parse_columns("a integer"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.csv").write_text("1\n2\n")
    checkpoint = f"{folder}/checkpoint"
    run = lambda: copy_landing(spark, "landed", f"{folder}/in", copy_options(format="CSV", structure="a Int32"), checkpoint).awaitTermination()
    run()
    (tmp_path / "in" / "two.csv").write_text("3\n")
    run()
    rows = lambda: sorted(r.a for r in spark.table("landed").collect())
    assert rows() == [1, 2, 3]
    # as if the last batch had failed after its rows were placed and before it was marked
    for gone in (*(tmp_path / "checkpoint" / "commits").glob("*1*"), *(tmp_path / "checkpoint" / "lakeferry").glob("*done-1*")):
        gone.unlink()
    run()
    spark.catalog.refreshTable("landed")
    assert rows() == [1, 2, 3]


def test_parts_are_loaded_all_or_none(spark, engine, folder, tmp_path):
    for name in ("low", "high"):
        catalog.create(spark, name, catalog.parse_columns("a integer"))
    (tmp_path / "x.csv").write_text("1\n5\n9\n")
    assert engine.copy_into_parts({"low": "a < 6", "high": "a > 4"}, f"{folder}/x.csv") == 3
    assert [sorted(r.a for r in spark.table(t).collect()) for t in ("low", "high")] == [[1, 5], [9]]
    with pytest.raises(Exception, match="nowhere"):
        engine.copy_into_parts({"low": "a < 6", "nowhere": "a >= 6"}, f"{folder}/x.csv")
    assert sorted(r.a for r in spark.table("low").collect()) == [1, 5]


def test_queries_leave_nothing_and_see_only_permitted_files(spark, engine, folder, tmp_path):
    from lakeferry.engine import Engine
    from lakeferry.operators.query import QueryError

    (tmp_path / "x.csv").write_text("1\n")
    before = {t.name for t in spark.catalog.listTables()}
    engine.query("CREATE TABLE gone_t AS SELECT 1 AS a", "a int")
    engine.query("CREATE VIEW gone_v AS SELECT 1 AS a", "a int")
    assert {t.name for t in spark.catalog.listTables()} == before and not [d for d in spark.catalog.listDatabases() if d.name.startswith("lakeferry_query")]
    for bad in ("CREATE TABLE default.kept_t AS SELECT 1 AS a", "CREATE DATABASE d2", "DROP DATABASE default", "SET x = 1", "INSERT OVERWRITE DIRECTORY '/tmp/x' USING csv SELECT 1"):
        with pytest.raises(ValueError):
            engine.query(bad, "a int")
    shut = Engine(spark, allow_files=False)
    with pytest.raises(PermissionError):
        shut.query(f"SELECT * FROM file('{tmp_path}/x.csv', 'CSV', 'a Int32')", "a int")
    assert [r.a for r in engine.query(f"SELECT * FROM file('{tmp_path}/x.csv', 'CSV', 'a Int32') -- url('x')", "a int").collect()] == [1]
    with pytest.raises(QueryError, match="query: SELECT nothing_there"):
        engine.query("SELECT nothing_there", "a int")

def test_the_upper_half_of_a_number(spark):
    import struct

    numbers = [0.0, -0.0, 1.0, 1.00390625, -1.0078125, 3.14159274, 1e38, -2.5e-38, 65535.0, 2.0**-126, float("inf"), float("-inf"), 7.0, 0.1]
    cut = lambda x: struct.unpack("<f", struct.pack("<I", struct.unpack("<I", struct.pack("<f", x))[0] & 0xFFFF0000))[0]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double").select("i", brain_float(F.col("x").cast("float")).alias("b")).orderBy("i").collect()
    assert [r.b for r in got] == [cut(x) for x in numbers]


def test_statements(spark, engine, folder, tmp_path):
    catalog.create(spark, "said", catalog.parse_columns("a integer, b text"))
    spark.sql("INSERT INTO said VALUES (1, 'x'), (2, 'its')")
    url = f"{folder}/with (odd) WHERE.csv"
    assert engine.sql(f"COPY said (b, \"a\") TO '{url}' WITH (format 'CSV', structure 'b Enum8(''x'' = 1, ''its'' = 2), a Int32');") == 2
    assert engine.sql(f"COPY said (b, a) FROM '{url}' (format 'CSV', structure 'b String, a Int32')") == 2
    assert sorted(map(tuple, spark.table("said").collect())) == [(1, "x"), (1, "x"), (2, "its"), (2, "its")]
    engine.sql(f"CREATE TABLE said2 (b varchar(9), n numeric(10, 2)) WITH (copy_from = '{url}', format = 'CSV')")
    assert sorted(r.b for r in spark.table("said2").collect()) == ["its", "x"]
    with pytest.raises(ValueError, match="cannot read the options"):
        engine.sql(f"COPY said FROM '{url}' (format 'CSV', x 'a' 'b')")
    with pytest.raises(ValueError, match="WHERE clause"):
        engine.sql(f"COPY said FROM '{url}' WHERE a > 1")


def test_read_only_and_single_files(spark, engine, folder):
    from lakeferry.engine import Engine

    shut = Engine(spark, read_only=True)
    for call in (lambda: shut.copy_from("x", f"{folder}/x"), lambda: shut.create_table("x", copy_from=f"{folder}/x"), lambda: shut.copy_into_parts({"x": "a"}, f"{folder}/x")):
        with pytest.raises(PermissionError, match="read-only"):
            call()
    for format in ("Avro", "JSON", "CSVWithNames"):
        with pytest.raises(ValueError, match="single file only"):
            engine.copy_to(spark.range(3), f"{folder}/x.dat", format=format, single_file=False)


def test_a_copy_can_be_cancelled(spark, engine, folder):
    import threading
    import time

    failed = []

    def run():
        try:
            engine.copy_to(spark.range(0, 1 << 28, 1, 8).selectExpr("max(sha2(string(id), 512)) AS x"), f"{folder}/x.csv")
        except Exception as e:
            failed.append(e)

    thread = threading.Thread(target=run)
    thread.start()
    time.sleep(4)
    engine.cancel()
    thread.join(30)
    assert not thread.is_alive() and failed


@pytest.mark.parametrize("format", ["TSV", "TSVWithNames", "JSONEachRow", "JSONCompactEachRowWithNames"])
def test_packed_files_are_dealt_out_by_lines(spark, engine, folder, format, monkeypatch):
    monkeypatch.setattr(textual, "PACKED_BYTES", 0)
    rows = spark.range(500).select("id", F.concat(F.lit("t\t\n"), F.col("id")).alias("t"))
    engine.copy_to(rows, f"{folder}/x.dat.gz", format=format)
    got = engine.read(f"{folder}/x.dat.gz", schema=rows.schema, format=format)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))


def test_declared_keys_and_policies(spark, engine, folder, tmp_path):
    from lakeferry.engine import Engine

    catalog.create(spark, "keyed", catalog.parse_columns("id integer PRIMARY KEY, code text UNIQUE, n integer"))
    (tmp_path / "a.csv").write_text('1,"x",1\n2,\\N,1\n3,\\N,1\n')
    (tmp_path / "b.csv").write_text('4,"x",1\n')
    (tmp_path / "c.csv").write_text('5,"y",1\n5,"z",1\n')
    assert engine.copy_from("keyed", f"{folder}/a.csv") == 3
    for name, key in (("a", "id"), ("b", "code"), ("c", "id")):
        with pytest.raises(ValueError, match=rf"unique constraint \({key}\)"):
            engine.copy_from("keyed", f"{folder}/{name}.csv")
    assert spark.table("keyed").count() == 3
    seen = []
    shut = Engine(spark, policy=lambda action, what: seen.append((action, what)) or action not in ("insert", "query", "select"))
    for call, text in ((lambda: shut.copy_from("keyed", f"{folder}/b.csv"), "insert keyed"), (lambda: shut.query("SELECT 1", "a int"), "query SELECT 1"), (lambda: shut.copy_to("keyed", f"{folder}/d.csv"), "select keyed")):
        with pytest.raises(PermissionError, match=f"permission denied to {text}"):
            call()
    assert shut.read(f"{folder}/b.csv", "a int, b text, c int").count() == 1 and ("read", f"{folder}/b.csv") in seen


COLUMN_LAYOUTS = {"plain": "JSONColumns", "meta": "JSONColumnsWithMetadata", "compact": "JSONCompactColumns"}


@pytest.mark.parametrize("layout", COLUMN_LAYOUTS)
@pytest.mark.parametrize("chunk", [1, 7, 1 << 18])
def test_columns_are_read_in_blocks(layout, chunk, monkeypatch):
    monkeypatch.setattr(streams, "CHUNK", chunk)
    rng = random.Random(2)
    scalars = [v for v in VALUES if not isinstance(v, (list, dict))]
    for n in (0, 1, streams.BLOCK - 1, streams.BLOCK, 2 * streams.BLOCK + 5):
        columns = {"a": [rng.choice(scalars) for _ in range(n)], "b": [rng.choice(scalars) for _ in range(n)], "c": [rng.choice(VALUES) for _ in range(n)]}
        document = {"plain": columns, "meta": {"meta": [{"name": "data"}], "data": columns, "rows": n}, "compact": [columns[k] for k in "cab"]}[layout]
        for indent in (None, 1):
            got = {"c": [], "a": []}
            for batch in streams.column_blocks(layout, ["c", "a"])(io.BytesIO(json.dumps(document, indent=indent).encode()), "x"):
                for _, block, at, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    assert block * streams.BLOCK == len(got["ca"[at]]) and len(json.loads(items)) <= streams.BLOCK
                    got["ca"[at]] += json.loads(items)
            assert got == {"c": columns["c"], "a": columns["a"]}


@pytest.mark.parametrize("layout", COLUMN_LAYOUTS)
@pytest.mark.parametrize("suffix", ["", ".gz", ".snappy"])
def test_columns_of_files_with_many_rows(spark, engine, folder, layout, suffix):
    """Rows keep together, in blocks over all tasks; no file is a row, as it was."""
    for k in range(2):
        engine.copy_to(spark.range(1000 * k, 1000 * k + 700).select("id", F.concat(F.lit('t\n"'), F.col("id")).alias("t"), F.array(F.col("id"), F.lit(None)).alias("a")), f"{folder}/x{k}.dat{suffix}", format=COLUMN_LAYOUTS[layout])
    got = engine.read(f"{folder}/x{{0..1}}.dat{suffix}", schema="id bigint, t text, a bigint[]", format=COLUMN_LAYOUTS[layout])
    assert sorted(map(tuple, got.collect())) == [(i, f't\n"{i}', [i, None]) for k in range(2) for i in range(1000 * k, 1000 * k + 700)]
    assert "wholetext" not in got._jdf.queryExecution().optimizedPlan().treeString() and len(list(got.inputFiles())) == 0


def test_columns_that_a_file_lacks_or_that_are_shorter(engine, folder, tmp_path):
    (tmp_path / "x.json").write_text('{"a": [1, 2, 3], "other": {"x": [1]}, "b": ["p", "q"], "d": null}')
    got = engine.read(f"{folder}/x.json", "b text, c int, a int, d int", format="JSONColumns")
    assert sorted(map(tuple, got.collect()), key=lambda r: r[2]) == [("p", None, 1, None), ("q", None, 2, None), (None, None, 3, None)]


def test_columns_under_a_key_that_holds_none(engine, folder, tmp_path):
    """What is no object of lists is refused before it is held, and an empty file has no rows."""
    read = lambda text: (tmp_path / "x.json").write_text(text) and None or engine.read(f"{folder}/x.json", "a int, b text", format="JSONColumnsWithMetadata").collect()
    for data, said in (('[{"a":1,"b":"x"}]', "data is no object"), ('"x"', "data is no object"), ('{"a":[9],"b":["p"]},"data":{"a":[2],"b":["q"]}', "'data' twice")):
        with pytest.raises(Exception, match=said):
            read('{"meta":[],"data":' + data + "}")
    assert read("") == [] and read('{"meta":[],"data":null}') == []


@pytest.mark.parametrize("layout", COLUMN_LAYOUTS)
def test_columns_are_written_line_by_line(spark, engine, folder, layout):
    """The writer reads its intermediate files by lines, not in batches of thousands of rows of any width; columns keep one order of rows."""
    from lakeferry.sources.textual import TEXT_FORMATS
    from lakeferry.types.grammar import parse_type

    df = spark.range(0, 3000, 1, 5).select("id", F.concat(F.lit("t\r\n "), F.col("id")).alias("t"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("n"))
    columns = [("id", parse_type("Int64")), ("t", parse_type("String")), ("n", parse_type("Nullable(Int64)"))]
    assert "parquet" not in TEXT_FORMATS[COLUMN_LAYOUTS[layout].lower()].encode(df, columns)._jdf.queryExecution().executedPlan().toString().lower()
    engine.copy_to(df, f"{folder}/x.json", format=COLUMN_LAYOUTS[layout])
    got = engine.read(f"{folder}/x.json", schema=df.schema, format=COLUMN_LAYOUTS[layout])
    assert sorted(map(tuple, got.collect())) == [(i, f"t\r\n {i}", i if i % 3 else None) for i in range(3000)]


@pytest.mark.parametrize("layout", COLUMN_LAYOUTS)
def test_blocks_of_long_texts(layout):
    """A block is what a task holds of a column at once: with long texts it must not take much either."""
    columns = {"a": ["x" * 100_000] * 300, "b": list(range(300))}
    document = {"plain": columns, "meta": {"data": columns}, "compact": list(columns.values())}[layout]
    batches = list(streams.column_blocks(layout, ["a", "b"])(io.BytesIO(json.dumps(document).encode()), "x"))
    assert max(len(t) for b in batches for t in b.column("items").to_pylist()) < 4_000_000 and max(b.nbytes for b in batches) < 8_000_000
