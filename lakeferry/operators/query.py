"""Ad-hoc SQL in a session of its own, its result held against the caller's columns."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from lakeferry.functions.coerce import to_column
from lakeferry.operators.create import describe
from lakeferry.plans import catalog
from lakeferry.plans.options import Settings, copy_options
from lakeferry.sources import formats
from lakeferry.sources.urls import locate
from lakeferry.types.grammar import FileType
from lakeferry.types.mapping import file_type

#: Functions by other names, as SQL functions of the session.
SHIMS = [
    "toInt32(x STRING) RETURNS INT RETURN cast(x AS INT)",
    "toInt64(x STRING) RETURNS BIGINT RETURN cast(x AS BIGINT)",
    "toFloat64(x STRING) RETURNS DOUBLE RETURN cast(x AS DOUBLE)",
    "toFloat32(x STRING) RETURNS FLOAT RETURN cast(x AS FLOAT)",
    "toDate32(x STRING) RETURNS DATE RETURN cast(x AS DATE)",
    "toDate(x STRING) RETURNS DATE RETURN cast(x AS DATE)",
    "toIPv4(x STRING) RETURNS STRING RETURN CASE WHEN x IS NULL OR regexp_like(x, '^((25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\\\\.|$)){4}$') THEN x ELSE raise_error(concat('Invalid IPv4 value: ', x)) END",
    "toUUID(x STRING) RETURNS STRING RETURN lower(x)",
    "replaceRegexpOne(s STRING, p STRING, r STRING) RETURNS STRING RETURN CASE WHEN regexp_instr(s, p) = 0 THEN s ELSE concat(substring(s, 1, regexp_instr(s, p) - 1), r, substring(s, regexp_instr(s, p) + length(regexp_substr(s, p)))) END",
]
_STORES = {"file": "file://", "url": "", "s3": "", "gcs": "", "azureBlobStorage": "", "hdfs": ""}
#: Functions that Spark has by another name.
NAMES = {"toString": "string", "countIf": "count_if", "groupArray": "collect_list", "groupUniqArray": "collect_set", "arrayJoin": "explode", "argMax": "max_by", "argMin": "min_by", "toYear": "year", "toMonth": "month", "toDayOfMonth": "day", "toHour": "hour", "has": "array_contains"}
#: Statements that a query may be besides one that returns rows: they see a database of their own, which goes with the call.
STATEMENTS = {"CreateTable", "CreateTableAsSelect", "CreateView", "CreateViewCommand", "DropTable", "DropView", "InsertIntoStatement", "ShowTables", "DescribeRelation", "TruncateTable", "AddColumns", "RenameTable"}
#: Characters of an error's text that are kept.
ERROR_CHARS = 4096
_LITERAL = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/", re.S)
_ARGS = r"\(((?:[^()]|\([^()]*\))*)\)"


class QueryError(ValueError):
    """What went wrong, and in which query."""


def masked(sql: str) -> tuple[str, list[str]]:
    """The text with literals, quoted names and comments replaced by numbers between marks, and what they stand for."""
    held: list[str] = []

    def hide(m: re.Match) -> str:
        held.append(m[0])
        return f"\0{len(held) - 1}\0"

    return _LITERAL.sub(hide, sql), held


def unmasked(text: str, held: list[str]) -> str:
    return re.sub("\0(\\d+)\0", lambda m: held[int(m[1])], text)


def rewrite(spark: SparkSession, sql: str, permit: Callable[[str], None] = lambda url: None) -> str:
    """Table functions over files become temporary views, each once ``permit(url)`` lets it; functions by other names get Spark's; those with arguments in the
    types' places become casts; ``WHERE 0`` a boolean. Nothing within literals, quoted names or comments is touched."""
    found: list[str] = []
    text, held = masked(sql)

    def view(m: re.Match) -> str:
        args = [held[int(a)][1:-1].replace("''", "'") for a in re.findall("\0(\\d+)\0", m[2])]
        if not args:
            return m[0]
        url = args[0] if "://" in args[0] else _STORES[m[1]] + args[0]
        permit(url)
        options = copy_options(format=args[1] if len(args) > 1 else None, structure=args[2] if len(args) > 2 else None)
        columns = describe(spark, url, options)
        name = f"lakeferry_source_{len(found)}"
        formats.read(spark, locate(url, options), columns, options).createOrReplaceTempView(name)
        found.append(name)
        return name

    text = re.sub(r"\b(file|url|s3|gcs|azureBlobStorage|hdfs)\s*" + _ARGS, view, text)
    text = re.sub(r"\btoDecimal64\s*\(\s*((?:[^(),]|\([^()]*\))+?)\s*,\s*(\d+)\s*\)", r"cast(\1 AS DECIMAL(18,\2))", text)
    text = re.sub("\\btoDateTime64\\s*\\(\\s*((?:[^(),]|\\([^()]*\\))+?)\\s*,\\s*\\d+\\s*,\\s*(\0\\d+\0)\\s*\\)", r"to_utc_timestamp(from_utc_timestamp(cast(\1 AS TIMESTAMP), current_timezone()), \2)", text)
    text = re.sub(r"\bnumbers\s*\(\s*(\d+)\s*\)", r"(SELECT id AS number FROM range(\1))", text)
    text = re.sub(r"\bsystem\.numbers\b", "(SELECT id AS number FROM range(9223372036854775807))", text)
    text = re.sub(r"\bsystem\.settings\b", "system_settings", text)
    text = re.sub(r"\b(?:uniqExact|uniq)\s*" + _ARGS, r"count(DISTINCT \1)", text)
    text = re.sub(rf"\b({'|'.join(NAMES)})(?=\s*\()", lambda m: NAMES[m[1]], text)
    text = re.sub(r"\bWHERE\s+([01])\b(?!\s*[=<>+*/-])", lambda m: "WHERE " + ("true" if m[1] == "1" else "false"), text, flags=re.I)
    return unmasked(text, held)


def statement_of(session: SparkSession, text: str) -> str | None:
    """The kind of a statement that is no query, or None. One that names objects of other databases, or is not in STATEMENTS, is refused."""
    plan = session._jsparkSession.sessionState().sqlParser().parsePlan(text)
    of = lambda name: session._jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.plans.logical.{name}").isInstance(plan)
    inserts = re.search(r"^[\s:+|-]*'?(InsertInto\w+)", plan.toString(), re.M)  # which may stand behind a WITH, or side by side
    if not of("Command") and not of("ParsedStatement") and not inserts:
        return None
    kind = inserts[1] if inserts else plan.getClass().getSimpleName()
    if kind not in STATEMENTS:
        raise ValueError(f"a query can't be a statement of this kind: {kind}")
    target = re.search(r"Unresolved(?:Identifier|Relation|Table|View|TableOrView|DBObjectName)?\w* \[([^\]]*)\]", plan.toString())
    if target and "," in target[1] and kind not in ("ShowTables",):
        raise ValueError(f"a statement in a query can name objects of its own database only, not {target[1].replace(', ', '.')}")
    return kind


def query(spark: SparkSession, sql: str, schema: str | S.StructType | None, params: dict | None, settings: Settings, version: str, permit: Callable[[str], None] = lambda url: None) -> DataFrame:
    """Rows of ``sql`` as the declared columns, by place. Nothing that the query makes outlives it.

    Views, functions and settings are a session's own. A statement that makes tables makes them in a database that is dropped before this returns.
    """
    if not schema:
        raise ValueError("a column definition list is required for query()")
    want = catalog.parse_columns(schema) if isinstance(schema, str) else schema
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    for shim in SHIMS:
        session.sql(f"CREATE TEMPORARY FUNCTION {shim}")
    rows = [("max_memory_usage", str(settings.max_memory << 20)), ("max_threads", str(settings.max_threads)), ("max_parsing_threads", str(settings.max_parsing_threads)), ("version", version)]
    session.createDataFrame(rows, "name string, value string").createOrReplaceTempView("system_settings")
    if settings.max_threads:
        session.conf.set("spark.sql.shuffle.partitions", str(settings.max_threads))
    text = rewrite(session, sql, permit)
    try:
        got = _run(session, text, params or {})
    except PySparkException as e:
        raise QueryError(f"{clipped(str(e))}\nquery: {clipped(sql)}") from e
    if len(got.columns) != len(want.fields):
        if got.isEmpty():
            return session.createDataFrame([], want)  # nothing streamed: nothing to hold against the columns
        raise ValueError(f"the query returned {len(got.columns)} columns, expected {len(want.fields)}")
    plain = got.toDF(*[f"_{i}" for i in range(len(got.columns))])
    types = [file_type(S.StructField(f.name, f.dataType, True)) for f in got.schema.fields]
    return plain.select(*[_declared(F.col(f"_{i}"), t, f).alias(f.name) for i, (t, f) in enumerate(zip(types, want.fields, strict=True))])


def _run(session: SparkSession, text: str, params: dict) -> DataFrame:
    if statement_of(session, text) is None:
        return session.sql(text, args=params)
    own = f"lakeferry_query_{uuid.uuid4().hex}"
    before = session.catalog.currentDatabase()
    session.sql(f"CREATE DATABASE {own}")
    try:
        session.catalog.setCurrentDatabase(own)
        got = session.sql(text, args=params)  # a statement has run when this returns, and its rows, if any, are few
        return session.createDataFrame(got.collect(), got.schema)
    finally:
        session.catalog.setCurrentDatabase(before)
        session.sql(f"DROP DATABASE {own} CASCADE")


def clipped(text: str, limit: int = ERROR_CHARS) -> str:
    """Without what names a request or a version, and not too long."""
    text = re.sub(r"\s*(?:Request ID: \S+|\(version [^)]*\))", "", text)
    return text if len(text) <= limit else text[:limit] + "..."


def _declared(c, t: FileType, f: S.StructField):
    return to_column(c, t, f)
