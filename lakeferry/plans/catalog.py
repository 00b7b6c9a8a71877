"""Tables and what Spark's catalog doesn't keep of them: logical types, NOT NULL, CHECK, defaults and generated columns, in field metadata."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

#: Names of column types -> (logical type, Spark type); types with digits are below.
_TYPES: dict[str, tuple[str, S.DataType]] = {
    "boolean": ("boolean", S.BooleanType()), "bool": ("boolean", S.BooleanType()),
    "smallint": ("smallint", S.ShortType()), "int2": ("smallint", S.ShortType()), "short": ("smallint", S.ShortType()),
    "integer": ("integer", S.IntegerType()), "int": ("integer", S.IntegerType()), "int4": ("integer", S.IntegerType()),
    "bigint": ("bigint", S.LongType()), "int8": ("bigint", S.LongType()), "long": ("bigint", S.LongType()),
    "oid": ("oid", S.LongType()), "xid8": ("xid8", S.DecimalType(20, 0)), "oid8": ("oid8", S.DecimalType(20, 0)),
    "real": ("real", S.FloatType()), "float4": ("real", S.FloatType()), "float": ("real", S.FloatType()),
    "double precision": ("double precision", S.DoubleType()), "float8": ("double precision", S.DoubleType()), "double": ("double precision", S.DoubleType()),
    "text": ("text", S.StringType()), "string": ("text", S.StringType()), "name": ("text", S.StringType()),
    "bytea": ("bytea", S.BinaryType()), "binary": ("bytea", S.BinaryType()),
    "date": ("date", S.DateType()), "interval": ("text", S.StringType()), "uuid": ("uuid", S.StringType()), "inet": ("inet", S.StringType()),
    "json": ("json", S.StringType()), "jsonb": ("jsonb", S.StringType()),
}


def column_type(text: str) -> tuple[str, S.DataType]:
    """(logical type, Spark type) of a column type's name."""
    text = re.sub(r"\s+", " ", text.strip().lower())
    if text.endswith("[]"):
        logical, kind = column_type(text[:-2])
        return logical + "[]", S.ArrayType(kind)
    found = re.fullmatch(r"([a-z][a-z0-9 ]*?) ?\(([\d, ]+)\)( with(?:out)? time zone)?", text)
    base, digits, zone = (found[1], [int(x) for x in found[2].split(",")], found[3] or "") if found else (text, [], "")
    if base in ("numeric", "decimal"):
        p, s = (digits + [0])[:2] if digits else (38, 18)
        return f"numeric({p},{s})", S.DecimalType(p, s) if p <= 38 else S.StringType()
    if base.startswith("timestamptz") or (base.startswith("timestamp") and "with time zone" in base + zone):
        return f"timestamp({digits[0] if digits else 6}) with time zone", S.TimestampType()
    if base.startswith("timestamp"):
        return f"timestamp({digits[0] if digits else 6})", S.TimestampNTZType()
    if base in ("char", "character", "bpchar", "varchar", "character varying", "bit", "varbit", "time", "timetz"):
        return f"{base}({digits[0]})" if digits else base, S.StringType()
    if base in _TYPES:
        return _TYPES[base]
    try:
        return "", S._parse_datatype_string(text)
    except Exception as e:
        raise ValueError(f'type "{text}" does not exist') from e


def _split(text: str) -> list[str]:
    """Parts between commas that stand in no brackets; ``<`` is one right after a type's name only."""
    out, depth, angle, at = [], 0, 0, 0
    for i, c in enumerate(text):
        depth += {"(": 1, ")": -1}.get(c, 0)
        if c == "<" and re.search(r"\b(array|map|struct)$", text[:i], re.I):
            angle += 1
        elif c == ">" and angle:
            angle -= 1
        if c == "," and not depth and not angle:
            out.append(text[at:i])
            at = i + 1
    return [p.strip() for p in [*out, text[at:]] if p.strip()]


def parse_columns(text: str) -> S.StructType:
    """``name type [NOT NULL] [UNIQUE | PRIMARY KEY] [DEFAULT expr] [GENERATED ALWAYS AS (expr)] [CHECK (expr)], ...``"""
    fields = []
    for part in _split(text):
        found = re.match(r'\s*(?:"((?:[^"]|"")+)"|`((?:[^`]|``)+)`|(\w+))\s+(.*)', part, re.S)
        if not found:
            raise ValueError(f"cannot read column definition {part!r}")
        name = (found[1] or "").replace('""', '"') or (found[2] or "").replace("``", "`") or found[3]
        rest, meta = found[4], {}
        for key, pattern in (("generated", r"\s+GENERATED ALWAYS AS \((.*?)\)(?: STORED)?(?=\s|$)"), ("check", r"\s+CHECK \((.*)\)"), ("default", r"\s+DEFAULT (.+?)(?=\s+NOT NULL|\s*$)")):
            m = re.search(pattern, rest, re.I | re.S)
            if m:
                meta[key] = m[1]
                rest = rest[: m.start()] + rest[m.end() :]
        not_null, unique = re.search(r"\s+(NOT NULL|PRIMARY KEY)\b", rest, re.I), re.search(r"\s+(UNIQUE|PRIMARY KEY)\b", rest, re.I)
        rest = re.sub(r"\s+(NOT NULL|PRIMARY KEY|UNIQUE|NULL)\b", "", rest, flags=re.I)
        logical, kind = column_type(rest)
        meta |= ({"logical": logical} if logical else {}) | ({"not_null": True} if not_null else {}) | ({"unique": True} if unique else {})
        fields.append(S.StructField(name, kind, not not_null, meta))
    return S.StructType(fields)


def table_schema(spark: SparkSession, table: str) -> S.StructType:
    """The table's columns, nullable as they were declared: Spark forgets that of stored tables."""
    fields = spark.table(table).schema.fields
    return S.StructType([S.StructField(f.name, f.dataType, f.nullable and not (f.metadata or {}).get("not_null", False), f.metadata) for f in fields])


def create(spark: SparkSession, table: str, schema: S.StructType, properties: dict[str, str] | None = None) -> None:
    kept = S.StructType([S.StructField(f.name, f.dataType, True, (f.metadata or {}) | ({} if f.nullable else {"not_null": True})) for f in schema.fields])
    writer = spark.createDataFrame([], kept).write.format("parquet")
    for k, v in (properties or {}).items():
        writer = writer.option(k, v)
    writer.saveAsTable(table)


def constrained(row: dict[str, Column], schema: S.StructType) -> dict[str, Column]:
    """Columns that raise where NOT NULL is broken."""
    out = {}
    for f in schema.fields:
        c = row[f.name]
        if not f.nullable:
            c = F.coalesce(c, F.raise_error(F.lit(f'null value in column "{f.name}" violates not-null constraint')).cast(f.dataType))
        out[f.name] = c
    return out


def checks(schema: S.StructType) -> list[str]:
    return [f.metadata["check"] for f in schema.fields if (f.metadata or {}).get("check")]


def unique_keys(schema: S.StructType) -> list[list[str]]:
    """Columns that were declared unique, each by itself."""
    return [[f.name] for f in schema.fields if (f.metadata or {}).get("unique")]
