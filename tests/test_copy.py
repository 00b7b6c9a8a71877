import pytest

from lakeferry.plans import catalog
from lakeferry.plans.options import copy_options
from lakeferry.streaming.landing import copy_landing


def table(spark, name, columns):
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    catalog.create(spark, name, catalog.parse_columns(columns))


def path_of(url):
    return url.removeprefix("file://")


def test_tab_separated_escapes(engine, folder):
    with open(path_of(folder) + "/p.tsv", "wb") as f:
        f.write(b"1\tO\\'Neil\ta\\tb\\nc\\\\d\\x40\n2\t\\N\t\\a\\v\\b\\f\\r\n")
    got = [tuple(r) for r in engine.read(f"{folder}/p.tsv", schema="id int, name text, note text").orderBy("id").collect()]
    assert got == [(1, "O'Neil", "a\tb\nc\\d@"), (2, None, "\a\v\b\f\r")]


def test_statements(engine, spark, folder):
    table(spark, "people", "id int NOT NULL, name text, rank int DEFAULT 5")
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string").createOrReplaceTempView("src")
    assert engine.copy_to("src", f"{folder}/x.csv") == 2
    assert engine.sql(f"COPY people (id, name) FROM '{folder}/x.csv' (format 'CSV')") == 2
    assert engine.sql(f"COPY people TO '{folder}/y.parquet'") == 2
    assert engine.sql(f"CREATE TABLE people2 () WITH (copy_from = '{folder}/y.parquet')") == 2
    assert sorted(map(tuple, spark.table("people2").collect())) == [(1, "a", 5), (2, "b", 5)]
    with pytest.raises(ValueError, match="WHERE clause"):
        engine.sql(f"COPY people FROM '{folder}/x.csv' WHERE id > 1")
    spark.sql("DROP TABLE people2")


def test_constraints_refuse_all_rows(engine, spark, folder):
    engine.copy_to(spark.createDataFrame([(1, 5), (2, None)], "id int, n int"), f"{folder}/x.parquet")
    table(spark, "strict", "id int, n int NOT NULL")
    with pytest.raises(Exception, match="violates not-null constraint"):
        engine.copy_from("strict", f"{folder}/x.parquet")
    assert spark.table("strict").count() == 0
    table(spark, "checked", "id int CHECK (id < 2), n int")
    with pytest.raises(Exception, match="violates check constraint"):
        engine.copy_from("checked", f"{folder}/x.parquet")
    table(spark, "keyed", "id int, n int")
    assert engine.copy_from("keyed", f"{folder}/x.parquet", unique=["id"]) == 2
    with pytest.raises(ValueError, match="unique constraint"):
        engine.copy_from("keyed", f"{folder}/x.parquet", unique=["id"])
    assert spark.table("keyed").count() == 2


def test_lengths_and_digits_are_applied_anew(engine, folder):
    with open(path_of(folder) + "/r.csv", "w") as f:
        f.write('1.2345,ab,"2024-01-15 12:34:56.789123","[1.2345,-6.789]",42,"2024-01-15 12:34:56"\n')
    structure = "value Decimal(10,4), sensor String, taken DateTime64(6,'UTC'), samples Array(Decimal(10,4)), seq Int64, logged DateTime('UTC')"
    got = engine.read(f"{folder}/r.csv", schema="value numeric(4,1), sensor char(3), taken timestamp(3), samples numeric(4,1)[], seq text, logged time", structure=structure)
    row = got.selectExpr("cast(value as string)", "sensor", "cast(taken as string)", "cast(samples as string)", "seq", "logged").first()
    assert tuple(row) == ("1.2", "ab ", "2024-01-15 12:34:56.789", "[1.2, -6.8]", "42", "12:34:56")


def test_definitions(engine, spark, folder):
    engine.copy_to(spark.createDataFrame([(1, [1])], "id int not null, a array<int>"), f"{folder}/x.tsv", format="TSVWithNamesAndTypes")
    assert engine.describe(f"{folder}/x.tsv", format="TSVWithNamesAndTypes") == [("id", "Int32"), ("a", "Array(Nullable(Int32))")]
    engine.create_table("made", structure_from=f"{folder}/x.tsv", format="TSVWithNamesAndTypes")
    assert [f.nullable for f in catalog.table_schema(spark, "made").fields] == [False, False]
    with pytest.raises(ValueError, match='relation "made" already exists'):
        engine.create_table("made", structure_from=f"{folder}/none.tsv", format="TSVWithNamesAndTypes")
    for wrong in ({"columns": "a int", "structure_from": "file:///x"}, {"structure_from": "file:///x", "copy_from": "file:///x"}, {"structure_from": "ftp://x"}, {"structure_from": "file:///x", "nonsense": 1}, {"copy_from": "file:///x", "if_not_exists": True}):
        with pytest.raises(ValueError):
            engine.create_table("other", **wrong)
    spark.sql("DROP TABLE made")


def test_every_layout_with_types_is_described_alike(engine, spark, folder):
    given = spark.createDataFrame([(1, "a")], "id int, s string")
    for format in ("CSVWithNamesAndTypes", "RowBinaryWithNamesAndTypes", "JSONCompactEachRowWithNamesAndTypes", "Native", "JSON", "JSONCompact", "Avro", "Parquet", "ORC", "Arrow", "ArrowStream"):
        engine.copy_to(given, f"{folder}/x", format=format)
        assert engine.describe(f"{folder}/x", format=format) == [("id", "Nullable(Int32)"), ("s", "Nullable(String)")], format


def test_query_is_isolated(engine, spark):
    engine.query("SELECT 1", "a int")
    assert not spark.catalog.tableExists("system_settings")
    with pytest.raises(ValueError, match="column definition list"):
        engine.query("SELECT 1")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        engine.query("SELECT 'x'", "a int").collect()


def test_files_can_be_forbidden(spark, folder):
    from lakeferry.engine import Engine

    with pytest.raises(PermissionError):
        Engine(spark, allow_files=False).read(f"{folder}/x.csv")


def test_landing(engine, spark, folder):
    table(spark, "landed", "id bigint")
    for k in range(2):
        engine.copy_to(spark.range(k * 10, k * 10 + 5), f"{folder}/in/{k}.csv")
        copy_landing(spark, "landed", f"{folder}/in", copy_options(format="CSV"), f"{folder}/checkpoint").awaitTermination()
    assert spark.table("landed").count() == 10


def test_interval_units(engine, spark, folder):
    given = spark.sql("SELECT 1 AS id, INTERVAL '36' HOUR AS i")
    with pytest.raises(Exception, match="interval does not fit IntervalDay"):
        engine.copy_to(given, f"{folder}/x", format="RowBinary", structure="id Int32, i IntervalDay")
    engine.copy_to(given, f"{folder}/x", format="RowBinary", structure="id Int32, i IntervalHour")
    assert engine.read(f"{folder}/x", schema="id int, n bigint", format="RowBinary", structure="id Int32, i IntervalHour").first()["n"] == 36


@pytest.fixture
def server():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    kept = {}

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            kept[self.path] = self.rfile.read(int(self.headers["Content-Length"]))
            self.send_response(200)
            self.end_headers()

        def do_GET(self):
            self.send_response(200 if self.path in kept else 404)
            self.end_headers()
            self.wfile.write(kept.get(self.path, b""))

        def log_message(self, *_):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}"
    http.shutdown()


@pytest.mark.parametrize("name", ["x.csv", "x.tsv.gz", "x.parquet", "x.avro"])
def test_http(engine, spark, server, name):
    given = spark.range(20).selectExpr("id", "cast(id as string) s")
    assert engine.copy_to(given, f"{server}/{name}") == 20
    assert engine.read(f"{server}/{name}", schema="id bigint, s text").exceptAll(given).count() == 0


def test_functions_by_other_names(engine):
    got = engine.query("SELECT replaceRegexpOne('a1b2', '[0-9]', '-'), toString(7), toInt64('8')", "a text, b text, c bigint").first()
    assert tuple(got) == ("a-b2", "7", 8)


def test_coercions_that_raise(engine, spark, folder):
    engine.copy_to(spark.createDataFrame([(1, 70000)], "id int, n int"), f"{folder}/x.parquet")
    with pytest.raises(Exception, match="CAST_OVERFLOW|out of range|overflow"):
        engine.read(f"{folder}/x.parquet", schema="id int, n smallint", structure="id Int32, n Int32").collect()
    with pytest.raises(Exception, match="Tuple requires 2 values, got 3"):
        engine.copy_to(spark.createDataFrame([(["a", "b", "c"],)], "t array<string>"), f"{folder}/y", format="TSV", structure="t Tuple(String, String)")
    with pytest.raises(ValueError, match="structure declares 1 columns, copy has 2"):
        engine.read(f"{folder}/x.parquet", schema="id int, n int", structure="id Int32")


def test_geometry(engine, spark, folder):
    given = spark.sql("SELECT 1 AS id, array(named_struct('x', 1.5D, 'y', double('nan')), named_struct('x', 0D, 'y', -2D)) AS line")
    for format in ("TSV", "JSONEachRow", "RowBinary", "Native", "MsgPack"):
        engine.copy_to(given, f"{folder}/g", format=format, structure="id Int32, line LineString")
        got = engine.read(f"{folder}/g", schema=given.schema, format=format, structure="id Int32, line LineString")
        assert repr(got.collect()) == repr(given.collect()), format


@pytest.mark.parametrize("format", ["TSV", "CSV", "JSONEachRow", "Parquet", "ORC"])
def test_many_files_at_once(engine, spark, folder, format):
    given = spark.range(0, 1000, 1, 5).selectExpr("id", "cast(id as string) s")
    assert engine.copy_to(given, f"{folder}/many", format=format, single_file=False) == 1000
    got = engine.read(f"{folder}/many", schema="id bigint, s text", format=format)
    assert got.exceptAll(given).count() == 0 and got.count() == 1000
    assert len([f for f in __import__("os").listdir(path_of(folder) + "/many") if f.startswith("part-")]) == 5
