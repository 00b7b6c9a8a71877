"""Queries over the engine's operators, each with the SQL that tells its result independently."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeferry.engine import Engine
from lakeferry.runtime import scratch
from lakeferry.sources.binary import BINARY_FORMATS
from lakeferry.sources.textual import TEXT_FORMATS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession) -> str:
    """A new folder's URL in the shared folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch(spark)}/q-{uuid.uuid4().hex}")
    url = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", url)


def new_table() -> str:
    return f"t_{uuid.uuid4().hex}"


ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"
EVENTS = "SELECT event_id, ts, user_id, event_type, value, props FROM events"


def _roundtrip(format: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e, url, rows = Engine(spark), f"{folder(spark)}/x.dat", table(spark, sf_dir, "orders")
        e.copy_to(rows, url, format=format)
        return e.read(url, schema=rows.schema, format=format)

    return run


for _format in [*TEXT_FORMATS, *BINARY_FORMATS, "parquet", "orc"]:
    register(f"roundtrip_{_format}", ORDERS)(_roundtrip(_format))


def _codec(codec: str, format: str, suffix: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e, url, rows = Engine(spark), f"{folder(spark)}/x.{format}{suffix}", table(spark, sf_dir, "events")
        named = {"tsv": "TSV", "csv": "CSV", "json": "JSONEachRow", "parquet": "Parquet"}[format]
        e.copy_to(rows, url, format=named, compression=codec)
        return e.read(url, schema=rows.schema, format=named, compression="auto" if format != "parquet" else codec)

    return run


for _c, _s in (("gzip", ".gz"), ("bz2", ".bz2"), ("zstd", ".zst"), ("xz", ".xz"), ("lz4", ".lz4"), ("brotli", ".br")):
    for _f in ("tsv", "csv", "json"):
        register(f"codec_{_c}_{_f}", EVENTS)(_codec(_c, _f, _s))
for _c in ("gzip", "zstd", "lz4", "snappy"):
    register(f"codec_{_c}_parquet", EVENTS)(_codec(_c, "parquet", ""))


# columns by name: the file has them in another order, and others besides

NAMED = [f for f in TEXT_FORMATS if "withnames" in f] + ["rowbinarywithnames", "rowbinarywithnamesandtypes", "native", "avro", "arrow", "arrowstream", "parquet", "orc"]


def _by_name(format: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e, url = Engine(spark), f"{folder(spark)}/x.dat"
        rows = table(spark, sf_dir, "orders").select("o_totalprice", "o_orderstatus", "o_custkey", "o_orderkey", "o_orderpriority")
        # row-binary with names alone has nothing that tells how to pass a column by
        e.copy_to(rows.drop("o_totalprice") if format == "rowbinarywithnames" else rows, url, format=format)
        return e.read(url, schema=rows.select("o_orderkey", "o_orderpriority", "o_custkey", "o_orderstatus").schema, format=format)

    return run


for _format in NAMED:
    register(f"copy_by_name_{_format}", "SELECT o_orderkey, o_orderpriority, o_custkey, o_orderstatus FROM orders")(_by_name(_format))


@register("copy_subset_parquet", "SELECT o_orderstatus, o_orderkey, NULL::INTEGER AS o_none FROM orders")
def copy_subset_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file with more columns than are asked for, and without one of them."""
    e, url, name = Engine(spark), f"{folder(spark)}/x.parquet", new_table()
    e.copy_to(table(spark, sf_dir, "orders"), url)
    _table(spark, name, "o_orderstatus text, o_orderkey bigint, o_none integer")
    e.copy_from(name, url)
    return spark.table(name)


def _two_headers(format: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Files of one pattern, each with its columns in an order of its own."""
        e, at, rows = Engine(spark), folder(spark), table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
        e.copy_to(rows.filter("n_nationkey < 9"), f"{at}/a.dat", format=format)
        e.copy_to(rows.filter("n_nationkey >= 9").select("n_name", "n_regionkey", "n_nationkey"), f"{at}/b.dat", format=format)
        return e.read(f"{at}/*.dat", schema=rows.schema, format=format)

    return run


for _format in ("tabseparatedwithnames", "csvwithnames", "csvwithnamesandtypes", "jsoncompacteachrowwithnames", "avro", "parquet"):
    register(f"copy_two_headers_{_format}", "SELECT n_nationkey, n_name, n_regionkey FROM nation")(_two_headers(_format))


# path patterns


def _globbed(pattern: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e, at = Engine(spark), folder(spark)
        lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
        for n in range(1, 8):
            e.copy_to(lines.filter(F.col("l_linenumber") == n), f"{at}/{'a' if n < 4 else 'b/c'}/part_{n}.csv", format="CSV")
        return e.read(f"{at}/{pattern}", schema=lines.schema, format="CSV")

    return run


for _k, _p, _n in (("star", "a/*.csv", "1,2,3"), ("qmark", "a/part_?.csv", "1,2,3"), ("alt", "{a/part_1,b/c/part_5}.csv", "1,5"), ("range", "b/c/part_{4..6}.csv", "4,5,6"), ("recursive", "**.csv", "1,2,3,4,5,6,7"), ("dir", "a", "1,2,3")):
    register(f"glob_{_k}", f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber IN ({_n})")(_globbed(_p))


# copies


@register("entry_slice", "SELECT l_returnflag, count(*)::BIGINT AS c, CAST(sum(l_quantity) AS DOUBLE) AS q FROM lineitem GROUP BY 1")
def entry_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, url, name = Engine(spark), f"{folder(spark)}/lineitem.parquet", new_table()
    e.copy_to(table(spark, sf_dir, "lineitem"), url)
    e.create_table(name, copy_from=url)
    return e.query(f"SELECT l_returnflag, count(*) AS c, sum(l_quantity) AS q FROM {name} GROUP BY 1", "l_returnflag text, c bigint, q double precision")


@register("copy_columns_subset", "SELECT n_nationkey, n_name, NULL::INTEGER AS n_regionkey FROM nation")
def copy_columns_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, url, name = Engine(spark), f"{folder(spark)}/n.tsv", new_table()
    e.copy_to(table(spark, sf_dir, "nation"), url, columns=["n_name", "n_nationkey"])
    _table(spark, name, "n_nationkey integer, n_name text, n_regionkey integer")
    e.copy_from(name, url, columns=["n_name", "n_nationkey"])
    return spark.table(name)


def _table(spark: SparkSession, name: str, columns: str) -> None:
    from lakeferry.plans import catalog

    catalog.create(spark, name, catalog.parse_columns(columns))


@register("copy_defaults", "SELECT n_nationkey, n_name, 7 AS grade, upper(n_name) AS loud FROM nation")
def copy_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, url, name = Engine(spark), f"{folder(spark)}/n.csv", new_table()
    e.copy_to(table(spark, sf_dir, "nation"), url, columns=["n_nationkey", "n_name"])
    _table(spark, name, "n_nationkey integer NOT NULL, n_name text, grade integer DEFAULT 3 + 4, loud text GENERATED ALWAYS AS (upper(n_name)) STORED")
    e.copy_from(name, url, columns=["n_nationkey", "n_name"])
    return spark.table(name)


@register("copy_rename_structure", "SELECT r_regionkey, r_name FROM region")
def copy_rename_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, url = Engine(spark), f"{folder(spark)}/r.json"
    e.copy_to(table(spark, sf_dir, "region"), url, format="JSONEachRow", structure="id Int32, `the name` String")
    return e.read(url, schema="r_regionkey int, r_name text", format="JSONEachRow", structure="id Int32,\n`the name` String")


@register("copy_overwrite", "SELECT r_regionkey, r_name FROM region WHERE r_regionkey > 2")
def copy_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, url, rows = Engine(spark), f"{folder(spark)}/r.csv", table(spark, sf_dir, "region")
    e.copy_to(rows, url)
    e.copy_to(rows.filter("r_regionkey > 2"), url)
    return e.read(url, schema=rows.schema)


@register("copy_count", "SELECT count(*)::BIGINT AS written, count(*)::BIGINT AS loaded FROM customer")
def copy_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, url, name, rows = Engine(spark), f"{folder(spark)}/c.parquet", new_table(), table(spark, sf_dir, "customer")
    written = e.copy_to(rows, url)
    return spark.createDataFrame([(written, e.create_table(name, copy_from=url))], "written long, loaded long")


@register("copy_empty", "SELECT count(*)::BIGINT AS n FROM region WHERE r_regionkey < 0")
def copy_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, url, rows = Engine(spark), f"{folder(spark)}/r.tsv", table(spark, sf_dir, "region")
    e.copy_to(rows.filter("r_regionkey < 0"), url)
    return e.read(url, schema=rows.schema).agg(F.count(F.lit(1)).alias("n"))


@register("copy_partition_routing", "SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN 'low' ELSE 'high' END AS part FROM orders")
def copy_partition_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, url, low, high = Engine(spark), f"{folder(spark)}/o.parquet", new_table(), new_table()
    for name in (low, high):
        _table(spark, name, "o_orderkey bigint, o_totalprice double precision")
    e.copy_to(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), url)
    e.copy_into_parts({low: "o_totalprice < 100000", high: "o_totalprice >= 100000"}, url)
    tag = lambda name, part: spark.table(name).select("o_orderkey", F.lit(part).alias("part"))
    return tag(low, "low").unionAll(tag(high, "high"))


def _refusal(spark: SparkSession, run: Callable[[], object], pattern: str) -> DataFrame:
    try:
        run()
        text = "none"
    except Exception as e:
        found = re.search(pattern, str(e))
        text = found[0] if found else str(e)[:200]
    return spark.createDataFrame([(text,)], "error string")


@register("copy_not_null_reject", """SELECT 'null value in column "n_name" violates not-null constraint' AS error""")
def copy_not_null_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, url, name = Engine(spark), f"{folder(spark)}/n.parquet", new_table()
    e.copy_to(table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") > 3, F.col("n_name")).alias("n_name")), url)
    _table(spark, name, "n_nationkey integer, n_name text NOT NULL")
    return _refusal(spark, lambda: e.copy_from(name, url), "null value in column .* violates not-null constraint")


for _k, _call, _text in (
    ("where", lambda e: e.copy_from("t", "file:///x", where="a > 1"), "COPY FROM a URL not supported with a WHERE clause"),
    ("option", lambda e: e.copy_from("t", "file:///x", freeze="true"), 'option "freeze" not supported'),
    ("timeout", lambda e: e.copy_from("t", "file:///x", timeout="-1"), 'argument to COPY option "timeout" must be a uint32'),
    ("relative", lambda e: e.describe("file://x.csv"), "relative path not allowed for COPY to file URL"),
    ("abfs", lambda e: e.describe("abfs://host/x.csv"), "Azure ABFS URL missing the container part"),
    ("azure", lambda e: e.describe("az://account/c/x.csv"), "Azure URL missing the storage account host"),
    ("both", lambda e: e.create_table("t", structure_from="file:///x", copy_from="file:///x"), 'cannot combine option "structure_from" with option "copy_from"'),
    ("definition", lambda e: e.query("SELECT 1"), "a column definition list is required for query()"),
    ("arity", lambda e: e.query("SELECT 1, 2", "a int"), "the query returned 2 columns, expected 1"),
):
    register(f"refuse_{_k}", f"SELECT '{_text}' AS error")(lambda spark, sf_dir, call=_call: _refusal(spark, lambda: call(Engine(spark)), ".*"))


# definitions from files


@register("create_infer_parquet", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def create_infer_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, url, name = Engine(spark), f"{folder(spark)}/c.parquet", new_table()
    e.copy_to(table(spark, sf_dir, "customer"), url)
    e.create_table(name, copy_from=url)
    return spark.table(name)


@register("create_infer_csv", "SELECT n_nationkey::BIGINT AS c1, n_name AS c2, n_regionkey::BIGINT AS c3 FROM nation")
def create_infer_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, url, name = Engine(spark), f"{folder(spark)}/n.csv", new_table()
    e.copy_to(table(spark, sf_dir, "nation"), url)
    e.create_table(name, copy_from=url)
    return spark.table(name)


@register("create_columns", "SELECT * FROM (VALUES ('req_id', 'bigint', false), ('name', 'text', false), ('path', 'text', true), ('nums', 'numeric(12,6)[]', false)) v(name, type, nullable)")
def create_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, name = Engine(spark), new_table()
    e.create_table(name, structure_from="file:///nowhere.csv", structure="req_id UInt32, name String, path Nullable(String), nums Array(Decimal(12, 6))")
    from lakeferry.plans import catalog

    return spark.createDataFrame([(f.name, f.metadata["logical"], f.nullable) for f in catalog.table_schema(spark, name).fields], "name string, type string, nullable boolean")


@register("create_nested_fallback", "SELECT n_nationkey, [n_name, n_regionkey::VARCHAR] AS t, [[n_name, n_nationkey::VARCHAR]] AS m FROM nation")
def create_nested_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, url, name = Engine(spark), f"{folder(spark)}/n.tsv", new_table()
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.struct("n_name", "n_regionkey").alias("t"), F.create_map("n_name", "n_nationkey").alias("m"))
    e.copy_to(rows, url, format="TSVWithNamesAndTypes")
    e.create_table(name, copy_from=url, format="TSVWithNamesAndTypes")
    return spark.table(name)


# coercions: a file's values as other column types


def _coerced(rows: Callable[[SparkSession, str], DataFrame], structure: str, schema: str, format: str = "JSONEachRow", shown: str | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e, url = Engine(spark), f"{folder(spark)}/x.dat"
        e.copy_to(rows(spark, sf_dir), url, format=format, structure=structure)
        got = e.read(url, schema=schema, format=format, structure=structure)
        if shown == "joined":
            return got.withColumn("v", F.array_join("v", ",", "-"))
        return got.withColumn("v", F.col("v").cast(shown)) if shown else got

    return run


register("coerce_decimal_round", "SELECT c_custkey, CAST(CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS DECIMAL(10,1)) AS DOUBLE) AS v FROM customer")(
    _coerced(lambda s, d: table(s, d, "customer").select("c_custkey", F.col("c_acctbal").cast("decimal(12,2)").alias("v")), "c_custkey Int64, v Decimal(12,2)", "c_custkey bigint, v numeric(10,1)", shown="double")
)
register("coerce_decimal_to_int", "SELECT c_custkey, CAST(round(CAST(c_acctbal AS DECIMAL(12,2)), 0) AS INTEGER) AS v FROM customer")(
    _coerced(lambda s, d: table(s, d, "customer").select("c_custkey", F.col("c_acctbal").cast("decimal(12,2)").alias("v")), "c_custkey Int64, v Decimal(12,2)", "c_custkey bigint, v integer")
)
register("coerce_float_to_int_round", "SELECT l_orderkey, l_linenumber, CAST(round_even(l_extendedprice / 2, 0) AS BIGINT) AS v FROM lineitem")(
    _coerced(lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 2).alias("v")), "a Int64, b Int32, v Float64", "l_orderkey bigint, l_linenumber integer, v bigint", "RowBinary")
)
register("coerce_int_bool", "SELECT o_orderkey, (o_orderkey % 4) <> 0 AS v FROM orders")(
    _coerced(lambda s, d: table(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).cast("short").alias("v")), "o_orderkey Int64, v UInt8", "o_orderkey bigint, v boolean")
)
register("coerce_num_text", "SELECT p_partkey, p_size::VARCHAR AS v FROM part")(
    _coerced(lambda s, d: table(s, d, "part").select("p_partkey", "p_size"), "p_partkey Int64, v Int32", "p_partkey bigint, v text", "Avro")
)
register("coerce_text_num", "SELECT p_partkey, p_size AS v FROM part")(
    _coerced(lambda s, d: table(s, d, "part").select("p_partkey", F.col("p_size").cast("string").alias("v")), "p_partkey Int64, v String", "p_partkey bigint, v integer", "CSV")
)
register("coerce_char_pad", "SELECT r_regionkey, rpad(r_name, 14, ' ') AS v FROM region")(
    _coerced(lambda s, d: table(s, d, "region"), "r_regionkey Int32, v String", "r_regionkey integer, v char(14)", "TSV")
)
register("coerce_ts_precision", "SELECT event_id, make_timestamp((round(epoch_us(ts) / 1000000.0, 0) * 1000000)::BIGINT) AS v FROM events")(
    _coerced(lambda s, d: table(s, d, "events").select("event_id", "ts"), "event_id Int64, v DateTime64(6,'UTC')", "event_id bigint, v timestamp(0)", "TSV")
)
register("coerce_ts_to_time", "SELECT event_id, strftime(ts, '%H:%M:%S') AS v FROM events")(
    _coerced(lambda s, d: table(s, d, "events").select("event_id", "ts"), "event_id Int64, v DateTime64(6,'UTC')", "event_id bigint, v time", "TSV")
)
register("coerce_array_elems", "SELECT o_orderkey, CAST(CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS DECIMAL(12,1)) AS VARCHAR) || ',-' AS v FROM orders")(
    _coerced(lambda s, d: table(s, d, "orders").select("o_orderkey", F.array(F.col("o_totalprice").cast("decimal(14,2)"), F.lit(None)).alias("v")), "o_orderkey Int64, v Array(Nullable(Decimal(14,2)))", "o_orderkey bigint, v numeric(12,1)[]", "CSV", "joined")
)
register("null_into_array", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN [o_custkey] ELSE [] END AS v FROM orders")(
    _coerced(lambda s, d: table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.array("o_custkey")).alias("v")), "o_orderkey Int64, v Array(Int64)", "o_orderkey bigint, v bigint[]", "TSV")
)
register("null_into_plain", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE 0 END AS v, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE '' END AS s FROM orders")(
    _coerced(lambda s, d: table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("v"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("s")), "o_orderkey Int64, v Int64, s String", "o_orderkey bigint, v bigint, s text", "RowBinary")
)
register("map_to_text2d", "SELECT n_nationkey, [[n_name, n_regionkey::VARCHAR]] AS m FROM nation")(
    _coerced(lambda s, d: table(s, d, "nation").select("n_nationkey", F.create_map("n_name", "n_regionkey").alias("m")), "n Int32, m Map(String, Int32)", "n_nationkey integer, m text[][]")
)
register("tuple_to_text", "SELECT n_nationkey, '(''' || n_name || ''',' || n_regionkey || ')' AS t FROM nation")(
    _coerced(lambda s, d: table(s, d, "nation").select("n_nationkey", F.struct(F.col("n_name").alias("a"), F.col("n_regionkey").alias("b")).alias("t")), "n Int32, t Tuple(a String, b Int32)", "n_nationkey integer, t text")
)
register("text_to_tuple", "SELECT n_nationkey, [n_name, n_regionkey::VARCHAR] AS t FROM nation")(
    _coerced(lambda s, d: table(s, d, "nation").select("n_nationkey", F.array("n_name", F.col("n_regionkey").cast("string")).alias("t")), "n Int32, t Tuple(a String, b Int32)", "n_nationkey integer, t text[]", "Native")
)
register("wide_uint64", "SELECT o_orderkey, (18446744073709551615::HUGEINT - o_orderkey)::VARCHAR AS v FROM orders")(
    _coerced(lambda s, d: table(s, d, "orders").select("o_orderkey", (F.lit("18446744073709551615").cast("decimal(20,0)") - F.col("o_orderkey")).cast("decimal(20,0)").alias("v")), "o_orderkey Int64, v UInt64", "o_orderkey bigint, v numeric(20,0)", "RowBinary", "string")
)
register("bfloat16", "SELECT l_orderkey, l_linenumber, max(CASE WHEN l_extendedprice = 0 THEN 0 ELSE floor(abs(x) / 2 ** (e - 7)) * 2 ** (e - 7) * sign(x) END)::FLOAT AS v FROM (SELECT *, l_extendedprice::FLOAT::DOUBLE AS x, floor(log2(nullif(abs(l_extendedprice::FLOAT::DOUBLE), 0))) AS e FROM lineitem) GROUP BY 1, 2")(
    _coerced(lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("float").alias("v")).groupBy("l_orderkey", "l_linenumber").agg(F.max("v").alias("v")), "l_orderkey Int64, l_linenumber Int32, v BFloat16", "l_orderkey bigint, l_linenumber integer, v real", "CSV")
)


def _documents(structure: str, format: str = "JSONEachRow") -> Query:
    """Documents made of a row's own numbers, through a file's JSON type into a table's binary one."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e, url, name = Engine(spark), f"{folder(spark)}/x.dat", new_table()
        text = F.concat(F.lit('{"long": '), F.col("n_regionkey"), F.lit(',"b":null, "c" : [1,  2], "a":'), F.col("n_nationkey"), F.lit("}"))
        e.copy_to(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 2 == 0, text).otherwise(F.lit('{"b": {"x": 1}, "k": "\u00e9"}')).alias("d")), url, format=format, structure="id Int32, d String")
        _table(spark, name, "id integer, d jsonb")
        e.copy_from(name, url, format=format, structure=f"id Int32, d {structure}")
        return spark.table(name)

    return run


_EVEN = """'{"c": [1, 2], "long": ' || n_regionkey || '}'"""
register("json_null_drop", """SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN '{"a": ' || n_nationkey || ', "c": [1, 2], "long": ' || n_regionkey || '}' ELSE '{"b": {"x": 1}, "k": "é"}' END AS d FROM nation""")(_documents("JSON", "TSV"))
register("json_skip_path", f"""SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN {_EVEN} ELSE '{{"k": "é"}}' END AS d FROM nation""")(_documents("JSON(max_dynamic_paths=1, SKIP a, SKIP b)", "TSV"))
register("json_typed_path", """SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN '{"a": ' || n_nationkey || ', "c": [1, 2], "t": {"s": ""}, "long": ' || n_regionkey || '}' ELSE '{"a": 0, "k": "é", "t": {"s": ""}}' END AS d FROM nation""")(_documents("JSON(a UInt32, t.s String, SKIP b)", "TSV"))
register("json_text_normalised", """SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN '{"a": ' || n_nationkey || ', "b": null, "c": [1, 2], "long": ' || n_regionkey || '}' ELSE '{"b": {"x": 1}, "k": "é"}' END AS d FROM nation""")(_documents("String", "CSV"))


@register("inet_forms", "SELECT n_nationkey, '10.0.0.' || n_nationkey AS v4, '2001:db8::' || format('{:x}', n_nationkey + 1) AS v6 FROM nation")
def inet_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, url, name = Engine(spark), f"{folder(spark)}/x.csv", new_table()
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("10.0.0."), F.col("n_nationkey"), F.lit("/32")).alias("v4"), F.concat(F.lit("2001:0DB8:0:0::"), F.lpad(F.hex(F.col("n_nationkey") + 1), 4, "0")).alias("v6"))
    e.copy_to(rows, url, structure="n_nationkey Int32, v4 IPv4, v6 IPv6")
    _table(spark, name, "n_nationkey integer, v4 inet, v6 inet")
    e.copy_from(name, url, structure="n_nationkey Int32, v4 IPv4, v6 IPv6")
    return spark.table(name)


@register("enum_label_reject", "SELECT 'refused' AS error")
def enum_label_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value that is no label of the file's enum."""
    e, url = Engine(spark), f"{folder(spark)}/x.tsv"
    seen = "refused"
    try:
        e.copy_to(table(spark, sf_dir, "orders").select("o_orderstatus"), url, structure="o_orderstatus Enum8('F' = 1, 'O' = 2)")
        seen = "written"
    except Exception as error:
        seen = seen if "Unknown element" in str(error) else str(error)
    return spark.createDataFrame([(seen,)], "error string")


register("wide_int128_text", "SELECT o_orderkey, (170141183460469231731687303715884105727::HUGEINT - o_orderkey)::VARCHAR AS v FROM orders")(
    _coerced(lambda s, d: table(s, d, "orders").select("o_orderkey", F.concat(F.lit("17014118346046923173168730"), F.lpad((F.lit(3715884105727) - F.col("o_orderkey")).cast("string"), 13, "0")).alias("v")), "o_orderkey Int64, v Int128", "o_orderkey bigint, v numeric(39,0)", "Native")
)


# time zones and intervals


@register("tz_export_berlin", "SELECT event_id, strftime(timezone('UTC', timezone('Europe/Berlin', ts)), '%Y-%m-%dT%H:%M:%S.%fZ') AS v FROM events")
def tz_export_berlin(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    e, url = Engine(session), f"{folder(spark)}/e.tsv"
    e.copy_to(table(session, sf_dir, "events").select("event_id", "ts"), url)
    return e.read(url, schema="event_id bigint, v text", structure="event_id Int64, v String")


@register("tz_import_shift", "SELECT event_id, timezone('America/New_York', timezone('UTC', ts)) AS v FROM events")
def tz_import_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    url, session = f"{folder(spark)}/e.tsv", spark.newSession()
    writer = spark.newSession()
    writer.conf.set("spark.sql.session.timeZone", "UTC")
    Engine(writer).copy_to(table(writer, sf_dir, "events").select("event_id", "ts"), url)
    session.conf.set("spark.sql.session.timeZone", "America/New_York")
    rows = Engine(session).read(url, schema="event_id bigint, v timestamp")
    from lakeferry.runtime import materialize

    kept = materialize(rows, "shifted")  # the zone counts when it is read
    return spark.read.schema(kept.schema).parquet(*kept.inputFiles())


for _unit, _seconds in (("Day", 86400), ("Hour", 3600), ("Minute", 60), ("Second", 1)):
    register(f"interval_units_{_unit.lower()}", "SELECT o_orderkey, o_orderkey % 50 AS n FROM orders")(
        _coerced(lambda s, d, k=_seconds: table(s, d, "orders").select("o_orderkey", F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("o_orderkey") % 50 * k).cast("decimal(18,6)")).alias("n")), f"o_orderkey Int64, n Interval{_unit}", "o_orderkey bigint, n bigint", "RowBinary")
    )


# text encoding


def _dirty(check: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e, url = Engine(spark), f"{folder(spark)}/d.tsv"
        e.copy_to(table(spark, sf_dir, "region").select("r_regionkey", F.concat("r_name", F.lit("\0"), F.lit("tail")).alias("v")), url)
        if check == "fail":
            return _refusal(spark, lambda: e.read(url, schema="r_regionkey int, v text", encoding_check=check).collect(), 'invalid byte sequence for encoding "UTF8": 0x00')
        return e.read(url, schema="r_regionkey int, v text", encoding_check=check.upper())

    return run


for _check, _sql in (("remove", "r_name || 'tail'"), ("replace", "r_name || chr(65533) || 'tail'"), ("truncate", "r_name")):
    register(f"enc_{_check}", f"SELECT r_regionkey, {_sql} AS v FROM region")(_dirty(_check))
register("enc_fail", """SELECT 'invalid byte sequence for encoding "UTF8": 0x00' AS error""")(_dirty("fail"))


# the query function and what is reached through it


def _ask(sql: str, schema: str, oracle: str | None = None, tables: tuple[str, ...] = (), params: dict | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = sql
        for t in tables:
            text = re.sub(rf"(?<=\s){t}(?=\s|$|,|\))", f"parquet.`{sf_dir}/{t}.parquet`" + ("" if re.search(rf"\s{t}\s+(?!ON|WHERE|GROUP|ORDER|JOIN|LEFT|RIGHT|FULL|CROSS|USING|UNION|INTERSECT|EXCEPT|LIMIT|INNER|SEMI|ANTI|HAVING)[a-z]", text) else ""), text)
        return Engine(spark).query(text, schema, params)

    return run


def ask(name: str, sql: str, schema: str, tables: str = "", oracle: str | None = "", params: dict | None = None) -> None:
    register(name, sql if oracle == "" else oracle)(_ask(sql, schema, oracle, tuple(tables.split()), params))


ask("query_numbers", "SELECT number AS n, number * 2 AS p FROM numbers(10)", "n int, p int", oracle="SELECT range::INTEGER AS n, (range * 2)::INTEGER AS p FROM range(10)")
ask("query_positional", "SELECT 1 AS x, 'a' AS y", "a smallint, b text", oracle="SELECT 1::SMALLINT AS a, 'a' AS b")
ask("query_empty_any_schema", "SELECT 1 WHERE 0", "x int, y text", oracle="SELECT 1 AS x, 'a' AS y WHERE false")
ask("query_params", "SELECT r_regionkey, r_name FROM region WHERE r_regionkey > :least", "r_regionkey int, r_name text", "region", "SELECT r_regionkey, r_name FROM region WHERE r_regionkey > 1", {"least": 1})
ask("query_types", "SELECT toInt32('7') AS i, toDecimal64(1.5, 3) AS d, toDate32('2024-01-15') AS dt, toUUID('61F0C404-5CB3-11E7-907B-A6006AD3DBA0') AS u", "i int, d double precision, dt text, u uuid", oracle="SELECT 7 AS i, 1.5::DOUBLE AS d, '2024-01-15' AS dt, '61f0c404-5cb3-11e7-907b-a6006ad3dba0' AS u")


@register("query_table_function_file", "SELECT r_name AS name, r_regionkey AS k FROM region WHERE r_regionkey <> 2")
def query_table_function_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, url = Engine(spark), f"{folder(spark)}/r.csv"
    e.copy_to(table(spark, sf_dir, "region"), url, format="CSVWithNamesAndTypes")
    return e.query(f"SELECT r_name, r_regionkey FROM url('{url}', 'CSVWithNamesAndTypes') WHERE r_regionkey <> 2", "name text, k int")


@register("query_ddl_gone", "SELECT 0::BIGINT AS tables")
def query_ddl_gone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that a query makes is gone after it, and so is the database that it was in."""
    e, name = Engine(spark), new_table()
    e.query(f"CREATE TABLE {name} AS SELECT 1 AS a", "a int")
    left = [t.name for d in spark.catalog.listDatabases() for t in spark.catalog.listTables(d.name)] + [d.name for d in spark.catalog.listDatabases()]
    return spark.createDataFrame([(sum(x == name or x.startswith("lakeferry_query_") for x in left),)], "tables bigint")


@register("query_file_refused", "SELECT 'permission denied to COPY from a file' AS error")
def query_file_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = f"{folder(spark)}/r.csv"
    Engine(spark).copy_to(table(spark, sf_dir, "region"), url, format="CSVWithNames")
    return _refusal(spark, lambda: Engine(spark, allow_files=False).query(f"SELECT r_name FROM file('{url}', 'CSVWithNames')", "name text"), "permission denied to COPY from a file")


ask("query_literals", "SELECT 'numbers(5)' AS a, 'WHERE 0' AS b, 'toString(1) -- it''s' AS c /* FROM file('x') */", "a text, b text, c text", oracle="SELECT 'numbers(5)' AS a, 'WHERE 0' AS b, 'toString(1) -- it''s' AS c")
ask("query_names", "SELECT r_regionkey % 2 AS k, countIf(r_regionkey > 1) AS c, uniq(r_name) AS u, size(groupArray(r_name)) AS g FROM region GROUP BY 1", "k int, c bigint, u bigint, g int", "region", "SELECT r_regionkey % 2 AS k, count(*) FILTER (r_regionkey > 1) AS c, count(DISTINCT r_name) AS u, count(*)::INTEGER AS g FROM region GROUP BY 1")


ask("settings_view", "SELECT name, value FROM system.settings WHERE name LIKE 'max%'", "name text, value text", oracle="SELECT * FROM (VALUES ('max_memory_usage', '0'), ('max_threads', '0'), ('max_parsing_threads', '0')) v(name, value)")


@register("version_semver", "SELECT true AS semver")
def version_semver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(bool(re.fullmatch(r"\d+\.\d+\.\d+", Engine(spark).version())),)], "semver boolean")


ask("rel_join_inner", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey", "n_name text, r_name text", "nation region")
ask("rel_join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000", "c_custkey bigint, o_orderkey bigint", "customer orders")
ask("rel_join_right", "SELECT c_custkey, o_orderkey FROM customer RIGHT JOIN orders ON c_custkey = o_custkey AND c_acctbal > 0", "c_custkey bigint, o_orderkey bigint", "customer orders")
ask("rel_join_full", "SELECT n_name, s_name FROM nation FULL JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 0", "n_name text, s_name text", "nation supplier")
ask("rel_join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", "c_custkey bigint", "customer orders")
ask("rel_join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", "c_custkey bigint", "customer orders")
ask("rel_join_cross", "SELECT a.r_name AS x, b.r_name AS y FROM region a CROSS JOIN region b", "x text, y text", "region")
ask("rel_join_range", "SELECT r_regionkey, n_nationkey FROM region JOIN nation ON n_nationkey BETWEEN r_regionkey AND r_regionkey + 2", "r_regionkey int, n_nationkey int", "region nation")
ask("rel_join_lateral", "SELECT r_regionkey, x FROM region LATERAL VIEW explode(sequence(1, r_regionkey + 1)) v AS x", "r_regionkey int, x int", "region", "SELECT r_regionkey, unnest(range(1, r_regionkey + 2))::INTEGER AS x FROM region")
ask("rel_join_asof", "SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END, true) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events", "event_id bigint, user_id bigint, last_purchase bigint", "events", "SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events")
ask("rel_agg", "SELECT l_returnflag, count(*) AS c, min(l_quantity) AS lo, max(l_quantity) AS hi, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS s FROM lineitem GROUP BY l_returnflag", "l_returnflag text, c bigint, lo double precision, hi double precision, s double precision", "lineitem")
ask("rel_agg_filter", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS big, count(DISTINCT o_custkey) AS custs FROM orders GROUP BY o_orderstatus HAVING count(*) > 1", "o_orderstatus text, big bigint, custs bigint", "orders")
ask("rel_agg_argmax", "SELECT o_custkey, max_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS top FROM orders GROUP BY o_custkey", "o_custkey bigint, top bigint", "orders", "SELECT o_custkey, arg_max(o_orderkey, {'a': o_totalprice, 'b': o_orderkey}) AS top FROM orders GROUP BY o_custkey")
ask("rel_agg_list", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "n_regionkey int, names text", "nation", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
ask("rel_distinct", "SELECT DISTINCT c_mktsegment FROM customer", "c_mktsegment text", "customer")
ask("rel_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS c FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())", "l_returnflag text, l_linestatus text, c bigint", "lineitem")
ask("rel_cube", "SELECT l_returnflag, l_linestatus, count(*) AS c FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", "l_returnflag text, l_linestatus text, c bigint", "lineitem")
ask("rel_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS c FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", "l_returnflag text, l_linestatus text, c bigint", "lineitem")
ask("rel_window_rank", "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders", "o_orderkey bigint, r int, n int", "orders", "SELECT o_orderkey, (rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC))::INTEGER AS r, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::INTEGER AS n FROM orders")
ask("rel_window_lag", "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev, lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders", "o_orderkey bigint, prev bigint, nxt bigint", "orders")
ask("rel_window_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c, max(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM orders", "o_orderkey bigint, c bigint, m bigint", "orders")
ask("rel_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", "o_orderkey bigint, o_totalprice double precision", "orders")
ask("rel_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 5", "o_orderkey bigint", "orders")
ask("rel_union", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region", "k int", "nation region")
ask("rel_union_all", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region", "k int", "nation region")
ask("rel_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", "k int", "customer supplier")
ask("rel_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier", "k int", "nation supplier")
ask("rel_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier", "k int", "customer supplier")
ask("rel_cte", "WITH t AS (SELECT o_custkey, count(*) AS c FROM orders GROUP BY o_custkey) SELECT c, count(*) AS n FROM t GROUP BY c", "c bigint, n bigint", "orders")
ask("rel_scalar_subquery", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT max(c_acctbal) * 40 FROM customer)", "o_orderkey bigint", "orders customer")
ask("rel_correlated", "SELECT c_custkey, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS last FROM customer", "c_custkey bigint, last bigint", "customer orders")
ask("rel_case", "SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN 'a' WHEN n_regionkey < 3 THEN 'b' ELSE 'c' END AS g, coalesce(nullif(n_regionkey, 1), -1) AS k FROM nation", "n_nationkey int, g text, k int", "nation")
ask("rel_functions", "SELECT n_nationkey, lower(n_name) AS l, concat(n_name, '-', n_regionkey) AS c, repeat('x', n_regionkey) AS r, right(n_name, 2) AS e, floor(n_nationkey / 3.0) AS f FROM nation", "n_nationkey int, l text, c text, r text, e text, f bigint", "nation")


@register("json_props_typed", "SELECT event_id, json_extract_string(props, '$.page') AS page FROM events")
def json_props_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark).query(f"SELECT event_id, get_json_object(props, '$.page') AS page FROM parquet.`{sf_dir}/events.parquet`", "event_id bigint, page text")


@register("nested_explode", "SELECT c_custkey, unnest([c_custkey, c_nationkey::BIGINT]) AS item FROM customer")
def nested_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, url = Engine(spark), f"{folder(spark)}/c.avro"
    e.copy_to(table(spark, sf_dir, "customer").select("c_custkey", F.array(F.col("c_custkey"), F.col("c_nationkey").cast("long")).alias("items")), url)
    return e.read(url, schema="c_custkey bigint, items bigint[]").select("c_custkey", F.explode("items").alias("item"))


@register("array_embed", "SELECT vec_id, label, i::INTEGER AS i, embedding[i + 1]::DOUBLE AS x FROM embeddings, range(len(embedding)) r(i)")
def array_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, url, rows = Engine(spark), f"{folder(spark)}/v.arrow", table(spark, sf_dir, "embeddings")
    e.copy_to(rows, url)
    got = e.read(url, schema=rows.schema).select("vec_id", "label", F.posexplode("embedding").alias("i", "x"))
    return got.withColumn("x", F.col("x").cast("double"))


@register("geo_points", "SELECT s_suppkey, s_acctbal AS x, -s_acctbal AS y FROM supplier")
def geo_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, url = Engine(spark), f"{folder(spark)}/s.tsv"
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.struct(F.col("s_acctbal").alias("x"), (-F.col("s_acctbal")).alias("y")).alias("p"))
    e.copy_to(rows, url, structure="k Int64, p Point")
    return e.read(url, schema=rows.schema, structure="k Int64, p Point").select("s_suppkey", "p.x", "p.y")



# statements, refusals and settings that have no rows of their own above


@register("stmt_copy", "SELECT n_nationkey, n_name || ' (x), WITH ''y''' AS n_name FROM nation")
def stmt_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ways by statements, with literals that hold what the statements are made of."""
    e, url, view, name = Engine(spark), f"{folder(spark)}/a (b).csv", new_table(), new_table()
    table(spark, sf_dir, "nation").selectExpr("n_nationkey", "concat(n_name, ' (x), WITH \\'y\\'') AS n_name", "n_regionkey").createOrReplaceTempView(view)
    e.sql(f"COPY {view} (n_name, n_nationkey) TO '{url}' WITH (format 'CSV', compression 'none')")
    _table(spark, name, "n_nationkey integer, n_name text")
    e.sql(f"COPY {name} (n_name, n_nationkey) FROM '{url}' (format = 'CSV');")
    spark.catalog.dropTempView(view)
    return spark.table(name)


@register("stmt_create", "SELECT r_regionkey, r_name FROM region")
def stmt_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, url, name = Engine(spark), f"{folder(spark)}/r.tsv.gz", new_table()
    e.copy_to(table(spark, sf_dir, "region"), url, format="TSVWithNamesAndTypes")
    e.sql(f"CREATE TABLE {name} WITH (copy_from = '{url}', format = 'TSVWithNamesAndTypes', fillfactor = 70)")
    return spark.table(name)


@register("http_both_ways", "SELECT r_regionkey, r_name FROM region")
def http_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posted to a server of this process, and read from it."""
    import http.server
    import threading

    held: dict[str, bytes] = {}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            held[self.path] = self.rfile.read(int(self.headers["Content-Length"]))
            self.send_response(200)
            self.end_headers()

        def do_GET(self):
            self.send_response(200 if self.path in held else 404)
            self.end_headers()
            self.wfile.write(held.get(self.path, b""))

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        e, url, rows = Engine(spark), f"http://127.0.0.1:{server.server_address[1]}/r.csv.gz", table(spark, sf_dir, "region").select("r_regionkey", "r_name")
        e.copy_to(rows, url, format="CSVWithNames")
        return spark.createDataFrame(e.read(url, schema=rows.schema, format="CSVWithNames").collect(), rows.schema)  # the server goes with this call
    finally:
        server.shutdown()


_ODD = "SELECT r_regionkey, r_name || chr(9) || 'tab' || chr(10) || 'line\\\\ \"q\" ''s'', ' || chr(13) || chr(8) || 'é' AS t FROM region".replace("\\\\", "\\")
for _format in ("tabseparated", "csv", "customseparated", "tskv", "values", "jsoneachrow", "jsoncompactstringseachrow"):

    def _escapes(spark: SparkSession, sf_dir: str, format: str = _format) -> DataFrame:
        e, url, name = Engine(spark), f"{folder(spark)}/x.dat", new_table()
        odd = F.concat("r_name", F.lit("\ttab\nline\\ \"q\" 's', \r\bé"))
        e.copy_to(table(spark, sf_dir, "region").select("r_regionkey", odd.alias("t")), url, format=format)
        _table(spark, name, "r_regionkey integer, t text")
        e.copy_from(name, url, format=format)
        return spark.table(name)

    register(f"escapes_{_format}", _ODD)(_escapes)


@register("fixed_string", "SELECT n_nationkey, left(n_name, 6) AS s FROM nation")
def fixed_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shorter values are filled up with zero bytes, which go again."""
    e, url = Engine(spark), f"{folder(spark)}/x.bin"
    e.copy_to(table(spark, sf_dir, "nation").select("n_nationkey", F.expr("left(n_name, 6)").alias("s")), url, format="RowBinary", structure="n_nationkey Int32, s FixedString(8)")
    return e.read(url, "n_nationkey integer, s text", format="RowBinary", structure="n_nationkey Int32, s FixedString(8)")


@register("landing_twice", "SELECT n_nationkey, n_name FROM nation")
def landing_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that arrive between two runs of a landing copy, each once."""
    from lakeferry.plans.options import copy_options
    from lakeferry.streaming.landing import copy_landing

    e, at, name, rows = Engine(spark), folder(spark), new_table(), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    _table(spark, name, "n_nationkey integer, n_name text")
    for k in range(2):
        e.copy_to(rows.filter(F.col("n_nationkey") % 2 == k), f"{at}/in/{k}.csv", format="CSV")
        copy_landing(spark, name, f"{at}/in", copy_options(format="CSV"), f"{at}/checkpoint").awaitTermination()
    return spark.table(name)


def _refused(name: str, text: str, call: Callable[[Engine, SparkSession, str, str], object], pattern: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _refusal(spark, lambda: call(Engine(spark), spark, sf_dir, folder(spark)), pattern)

    register(name, "SELECT '" + text.replace("'", "''") + "' AS error")(run)


def _again(e: Engine, spark: SparkSession, sf_dir: str, at: str) -> None:
    name = new_table()
    e.copy_to(table(spark, sf_dir, "region"), f"{at}/r.csv", columns=["r_regionkey", "r_name"])
    _table(spark, name, "r_regionkey integer, r_name text")
    for _ in range(2):
        e.copy_from(name, f"{at}/r.csv", unique=["r_regionkey"])


def _nowhere(e: Engine, spark: SparkSession, sf_dir: str, at: str) -> None:
    name = new_table()
    e.copy_to(table(spark, sf_dir, "region"), f"{at}/r.csv", columns=["r_regionkey"])
    _table(spark, name, "r_regionkey integer")
    e.copy_into_parts({name: "r_regionkey < 2"}, f"{at}/r.csv")


def _exists(e: Engine, spark: SparkSession, sf_dir: str, at: str) -> None:
    e.copy_to(table(spark, sf_dir, "region"), f"{at}/r.parquet")
    name = new_table()
    for _ in range(2):
        e.create_table(name, copy_from=f"{at}/r.parquet")


def _checked(e: Engine, spark: SparkSession, sf_dir: str, at: str) -> None:
    name = new_table()
    e.copy_to(table(spark, sf_dir, "region"), f"{at}/r.csv", columns=["r_regionkey"])
    _table(spark, name, "r_regionkey integer CHECK (r_regionkey < 3)")
    e.copy_from(name, f"{at}/r.csv")


def _no_columns(e: Engine, spark: SparkSession, sf_dir: str, at: str) -> None:
    e.copy_to(table(spark, sf_dir, "region"), f"{at}/r.csv", format="CSVWithNames", columns=["r_name"])
    e.read(f"{at}/r.csv", "r_regionkey integer", format="CSVWithNames")


_refused("refuse_unique", "duplicate key value violates unique constraint (r_regionkey)", _again, r"duplicate key value violates unique constraint \(r_regionkey\)")
_refused("refuse_partition", "no partition of relation found for row", _nowhere, "no partition of relation found for row")
_refused("refuse_existing", '" already exists', _exists, '" already exists$')
_refused("refuse_check", "new row violates check constraint (r_regionkey < 3)", _checked, r"new row violates check constraint \(r_regionkey < 3\)")
_refused("refuse_interval", "interval does not fit IntervalDay", lambda e, s, d, at: e.copy_to(s.sql("SELECT INTERVAL '36' HOUR AS i"), f"{at}/x", format="RowBinary", structure="i IntervalDay"), "interval does not fit IntervalDay")
_refused("refuse_no_shared_column", "the file has none of the columns r_regionkey; it has r_name", _no_columns, "the file has none of the columns r_regionkey; it has r_name")
_refused("refuse_read_only", "cannot execute COPY FROM in a read-only transaction", lambda e, s, d, at: Engine(s, read_only=True).copy_from("t", f"{at}/x"), "cannot execute COPY FROM in a read-only transaction")
_refused("refuse_column", 'column "nope" does not exist', lambda e, s, d, at: e.copy_to(table(s, d, "region"), f"{at}/x.csv", columns=["nope"]), 'column "nope" does not exist')
_refused("refuse_memory", '65536 MB is outside the valid range for parameter "max_memory" (0 MB .. 65535 MB)', lambda e, s, d, at: Engine(s, max_memory=65536), ".*")
_refused("refuse_other_database", "a statement in a query can name objects of its own database only, not default.x", lambda e, s, d, at: e.query("CREATE TABLE default.x AS SELECT 1 AS a", "a int"), "a statement in a query.*")
_refused("query_error_context", "query: SELECT nothing_there", lambda e, s, d, at: e.query("SELECT nothing_there", "a int"), "query: .*")
_refused("query_error_clipped", "...", lambda e, s, d, at: e.query("SELECT nothing_there, '" + "x" * 9000 + "'", "a int"), r"\.\.\.$")


@register("log_redacted", "SELECT true AS told, false AS leaked")
def log_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a copy logs names its file, and no key."""
    import logging

    lines: list[str] = []
    keep, log = logging.Handler(), logging.getLogger("lakeferry")
    keep.emit = lambda record: lines.append(record.getMessage())
    log.addHandler(keep)
    before, level = log.level, log.setLevel(logging.DEBUG)
    try:
        Engine(spark).copy_to(table(spark, sf_dir, "region"), f"{folder(spark)}/r.csv", access_key="key-one", access_secret="hush-hush", session_token="tok-two")
    finally:
        log.setLevel(before)
        log.removeHandler(keep)
    text = "\n".join(lines)
    return spark.createDataFrame([("r.csv" in text and "***" in text, any(x in text for x in ("key-one", "hush-hush", "tok-two")))], "told boolean, leaked boolean")


ask("rel_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier", "k int", "customer supplier")
ask("rel_approx_distinct", "SELECT approx_count_distinct(n_regionkey) AS k FROM nation", "k bigint", "nation", "SELECT count(DISTINCT n_regionkey) AS k FROM nation")
