"""File-level types to Spark types and back, with what Spark can't hold kept as logical types in field metadata.

Fixed correspondences (both tables below) are part of the data model; a field's logical type is in metadata ``logical``.
"""

from __future__ import annotations

from pyspark.sql import types as S

from lakeferry.types.grammar import FileType, parse_type, render_type

POINT = S.StructType([S.StructField("x", S.DoubleType()), S.StructField("y", S.DoubleType())])

#: File-level scalar -> (Spark type, logical type of a table's column).
SCALARS: dict[str, tuple[S.DataType, str]] = {
    "Bool": (S.BooleanType(), "boolean"),
    "Int8": (S.ShortType(), "smallint"),
    "UInt8": (S.ShortType(), "smallint"),
    "Int16": (S.ShortType(), "smallint"),
    "UInt16": (S.IntegerType(), "integer"),
    "Int32": (S.IntegerType(), "integer"),
    "UInt32": (S.LongType(), "bigint"),
    "Int64": (S.LongType(), "bigint"),
    "UInt64": (S.DecimalType(20, 0), "numeric(20,0)"),
    "Int128": (S.StringType(), "numeric(39,0)"),
    "UInt128": (S.StringType(), "numeric(39,0)"),
    "Int256": (S.StringType(), "numeric(77,0)"),
    "UInt256": (S.StringType(), "numeric(78,0)"),
    "BFloat16": (S.FloatType(), "real"),
    "Float32": (S.FloatType(), "real"),
    "Float64": (S.DoubleType(), "double precision"),
    "Date": (S.DateType(), "date"),
    "Date32": (S.DateType(), "date"),
    "DateTime": (S.TimestampType(), "timestamp with time zone"),
    "Time": (S.StringType(), "time"),
    "String": (S.StringType(), "text"),
    "UUID": (S.StringType(), "uuid"),
    "IPv4": (S.StringType(), "inet"),
    "IPv6": (S.StringType(), "inet"),
    "JSON": (S.StringType(), "jsonb"),
    "Point": (POINT, "point"),
    "LineString": (S.ArrayType(POINT), "path"),
    "Ring": (S.ArrayType(POINT), "polygon"),
    "MultiLineString": (S.ArrayType(S.ArrayType(POINT)), "path[]"),
    "Polygon": (S.ArrayType(S.ArrayType(POINT)), "polygon[]"),
    "MultiPolygon": (S.ArrayType(S.ArrayType(S.ArrayType(POINT))), "polygon[][]"),
}
MONTH_UNITS = {"Year": 12, "Quarter": 3, "Month": 1}
#: Nanoseconds of each unit.
TIME_UNITS = {"Week": 604800 * 10**9, "Day": 86400 * 10**9, "Hour": 3600 * 10**9, "Minute": 60 * 10**9, "Second": 10**9, "Millisecond": 10**6, "Microsecond": 10**3, "Nanosecond": 1}
#: Formats without a type for the time of day, in which it is text.
NO_TIME = {"parquet", "arrow", "arrowstream", "orc", "avro", "protobuf", "protobuflist", "msgpack", "bsoneachrow"}
GEO = {"Point", "LineString", "Ring", "MultiLineString", "Polygon", "MultiPolygon"}


def _decimal(p: int, s: int) -> tuple[S.DataType, str]:
    return (S.DecimalType(p, s) if p <= 38 else S.StringType()), f"numeric({p},{s})"


def _unsupported(t: FileType, column: str) -> ValueError:
    return ValueError(f'unsupported column type "{render_type(t)}" (column "{column}")')


def scalar(t: FileType, column: str = "") -> tuple[S.DataType, str] | None:
    """(Spark type, logical type) of a scalar; None for what is not one."""
    if t.name == "Decimal":
        return _decimal(t.args[0], t.args[1] if len(t.args) > 1 else 0)
    if t.name in ("Decimal32", "Decimal64", "Decimal128", "Decimal256"):
        return _decimal({"32": 9, "64": 18, "128": 38, "256": 76}[t.name[7:]], t.args[0])
    if t.name == "DateTime64":
        return S.TimestampType(), f"timestamp({min(t.args[0] if t.args else 3, 6)}) with time zone"
    if t.name == "Time64":
        return S.StringType(), f"time({min(t.args[0] if t.args else 3, 6)})"
    if t.name in ("FixedString", "Enum8", "Enum16", "Enum"):
        return S.StringType(), "text"
    if t.name.startswith("Interval"):
        if t.name[8:] in MONTH_UNITS:
            return S.YearMonthIntervalType(), "interval"
        if t.name[8:] in TIME_UNITS:
            return S.DayTimeIntervalType(), "interval"
    return SCALARS.get(t.name)


def wire_type(t: FileType, column: str = "") -> S.DataType:
    """The Spark type that holds a file's values with all their structure."""
    t = t.plain
    found = scalar(t, column)
    if found:
        return found[0]
    if t.name == "Array":
        return S.ArrayType(wire_type(t.args[0], column))
    if t.name == "Map":
        return S.MapType(wire_type(t.args[0], column), wire_type(t.args[1], column))
    if t.name in ("Tuple", "Nested"):
        names = t.fields or tuple(str(i + 1) for i in range(len(t.args)))
        of = S.StructType([S.StructField(n, wire_type(a, column)) for n, a in zip(names, t.args, strict=True)])
        return S.ArrayType(of) if t.name == "Nested" else of
    raise _unsupported(t, column)


def column_field(name: str, t: FileType, notices: list[str] | None = None) -> S.StructField:
    """The table column that inference makes: nullable as the file's type says; tuples, maps and nested become arrays of text with a notice."""
    depth, inner = 0, t.plain
    while inner.name == "Array":
        depth, inner = depth + 1, inner.args[0].plain
    found = scalar(inner, name)
    if found:
        kind, logical = found
    elif inner.name in ("Tuple", "Map", "Nested"):
        wire_type(inner, name)  # raises for what can't be held at all
        extra = 1 if inner.name == "Tuple" else 2
        if notices is not None:
            notices.append(f'column "{name}" of type "{render_type(t)}" converted to text{"[]" * (depth + extra)}')
        kind, logical = S.StringType(), "text"
        for _ in range(extra):
            kind, logical = S.ArrayType(kind), logical + "[]"
    else:
        raise _unsupported(inner, name)
    for _ in range(depth):
        kind, logical = S.ArrayType(kind), logical + "[]"
    return S.StructField(name, kind, t.nullable, {"logical": logical, "file_type": render_type(t)})


#: Logical type of a table's column -> file-level type; others are String.
_ENCODE = {
    "boolean": "Bool", "smallint": "Int16", "integer": "Int32", "bigint": "Int64", "oid": "UInt32", "xid8": "UInt64", "oid8": "UInt64",
    "real": "Float32", "double precision": "Float64", "numeric": "Decimal256(38)", "date": "Date32", "time": "Time64(6)", "uuid": "UUID",
    "point": "Point", "lseg": "LineString", "path": "LineString", "polygon": "Ring", "bytea": "String", "text": "String",
    "box": "Tuple(high Point, low Point)", "circle": "Tuple(center Point, radius Float64)", "line": "Tuple(a Float64, b Float64, c Float64)",
}


def _from_logical(logical: str) -> FileType:
    if logical.endswith("[]"):
        inner = _from_logical(logical[:-2])
        bare = inner.name in ("Array", "LineString", "Ring", "MultiLineString", "Polygon", "MultiPolygon")
        return FileType("Array", (inner if bare else FileType("Nullable", (inner,)),))
    base = logical.split("(")[0].strip()
    if base == "numeric" and "(" in logical:
        p, _, s = logical[logical.index("(") + 1 : -1].partition(",")
        return FileType("Decimal", (int(p), int(s or 0))) if int(p) <= 76 else parse_type("Decimal256(38)")
    if base == "timestamp":
        return FileType("DateTime64", (6, "UTC"))
    return parse_type(_ENCODE.get(base, "String"))


def logical_type(f: S.StructField) -> str:
    """The logical type of a table's column: its metadata's, else what its Spark type says."""
    return f.metadata["logical"] if f.metadata and "logical" in f.metadata else _spark_logical(f.dataType)


def _spark_logical(d: S.DataType) -> str:
    plain = {S.BooleanType: "boolean", S.ByteType: "smallint", S.ShortType: "smallint", S.IntegerType: "integer", S.LongType: "bigint", S.FloatType: "real", S.DoubleType: "double precision", S.DateType: "date", S.TimestampType: "timestamp with time zone", S.TimestampNTZType: "timestamp", S.BinaryType: "bytea", S.YearMonthIntervalType: "interval", S.DayTimeIntervalType: "interval"}
    if type(d) in plain:
        return plain[type(d)]
    if isinstance(d, S.DecimalType):
        return f"numeric({d.precision},{d.scale})"
    if isinstance(d, S.ArrayType):
        return _spark_logical(d.elementType) + "[]"
    return "text"


def file_type(f: S.StructField) -> FileType:
    """The file-level type of a table's column: of scalars and arrays by its logical type, of structs and maps by their parts."""
    inner = _spark_file_type(f.dataType) if not (f.metadata or {}).get("logical") else _from_logical(logical_type(f))
    bare = inner.name in ("Array", "Map", "Tuple", "Nested", "LineString", "Ring", "MultiLineString", "Polygon", "MultiPolygon")
    return FileType("Nullable", (inner,)) if f.nullable and not bare else inner


def _spark_file_type(d: S.DataType) -> FileType:
    if isinstance(d, S.StructType):
        return FileType("Tuple", tuple(_nullable(_spark_file_type(f.dataType)) for f in d.fields), tuple(f.name for f in d.fields))
    if isinstance(d, S.MapType):
        return FileType("Map", (_spark_file_type(d.keyType), _nullable(_spark_file_type(d.valueType))))
    if isinstance(d, S.ArrayType):
        return FileType("Array", (_nullable(_spark_file_type(d.elementType)),))
    return _from_logical(_spark_logical(d))


def _nullable(t: FileType) -> FileType:
    return t if t.name in ("Array", "Map", "Tuple", "Nested", "LineString", "Ring") else FileType("Nullable", (t,))


def structure_of(schema: S.StructType, format: str = "") -> list[tuple[str, FileType]]:
    """The structure that is written for a table: UUIDs are text in ORC, and times are text in formats without them."""
    out = []
    for f in schema.fields:
        t = file_type(f)
        if format.lower() == "orc":
            t = _replace(t, "UUID", FileType("String"))
        if format.lower() in NO_TIME:
            t = _replace(t, "Time64", FileType("String"))
        out.append((f.name, t))
    return out


def _replace(t: FileType, name: str, by: FileType) -> FileType:
    if t.name == name:
        return by
    return FileType(t.name, tuple(_replace(a, name, by) if isinstance(a, FileType) else a for a in t.args), t.fields)
