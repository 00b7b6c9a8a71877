"""From a file's values to a table's columns, as column expressions chosen when the plan is made.

Numbers are rounded when they lose digits, never cut; what is out of range raises, as ANSI casts do.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

from lakeferry.functions.documents import address, binary_json, json_document
from lakeferry.functions.text import brain_float, geo_as_nested, interval_units, literal, nested, parse_scalar, scalar_text
from lakeferry.types.grammar import FileType
from lakeferry.types.mapping import GEO, logical_type, wire_type

_BAD = "�"


def check_text(c: Column, check: str) -> Column:
    """Text without NUL and invalid UTF-8: such text raises, or loses the bytes, or gets U+FFFD in their place, or ends there."""
    clean = F.replace(F.make_valid_utf8(c), F.lit("\0"), F.lit(_BAD))
    dirty = c.contains("\0") | ~F.is_valid_utf8(c)
    if check == "fail":
        fixed: Column = F.raise_error(F.lit('invalid byte sequence for encoding "UTF8": 0x00')).cast("string")
    elif check == "remove":
        fixed = F.replace(clean, F.lit(_BAD), F.lit(""))
    elif check == "truncate":
        fixed = F.substring_index(clean, _BAD, 1)
    else:
        fixed = clean
    return F.when(dirty, fixed).otherwise(c)


def default_of(t: FileType) -> Column:
    """What a null becomes where the file's type takes none."""
    kind = wire_type(t)
    if isinstance(kind, S.ArrayType):
        return F.array().cast(kind)
    if isinstance(kind, S.MapType):
        return F.create_map().cast(kind)
    if isinstance(kind, S.StructType):
        name = t.plain.name
        return F.raise_error(F.lit(f"cannot encode record into {name}(...)")).cast(kind)
    if isinstance(kind, S.StringType):
        zero = {"UUID": "00000000-0000-0000-0000-000000000000", "IPv4": "0.0.0.0", "IPv6": "::", "Time": "00:00:00", "Time64": "00:00:00"}.get(t.plain.name)
        return F.lit("0" if t.plain.name.startswith(("Int", "UInt")) else zero or "")
    if isinstance(kind, S.DateType):
        return F.lit("1970-01-01").cast("date")
    if isinstance(kind, S.TimestampType):
        return F.timestamp_micros(F.lit(0))
    if isinstance(kind, S.YearMonthIntervalType):
        return F.make_ym_interval(F.lit(0), F.lit(0))
    if isinstance(kind, S.DayTimeIntervalType):
        return F.make_dt_interval()
    return F.lit(False) if isinstance(kind, S.BooleanType) else F.lit(0).cast(kind)


def to_wire(c: Column, have: S.DataType, t: FileType) -> Column:
    """A table's value as the file's type holds it."""
    want = wire_type(t)
    bare = t.plain
    if bare.name == "Array" and isinstance(have, S.ArrayType):
        out = F.transform(c, lambda x: to_wire(x, have.elementType, bare.args[0]))
    elif bare.name == "Tuple" and isinstance(have, S.ArrayType):
        names = bare.fields or [str(i + 1) for i in range(len(bare.args))]
        n = len(bare.args)
        parts = F.struct(*[parse_scalar(F.element_at(c, i + 1), a).alias(x) for i, (x, a) in enumerate(zip(names, bare.args, strict=True))])
        bad = F.raise_error(F.concat(F.lit(f"Tuple requires {n} values, got "), F.size(c).cast("string"))).cast(want)
        out = F.when(c.isNotNull() & (F.size(c) != n), bad).when(c.isNotNull(), parts)
    elif bare.name == "Map" and isinstance(have, S.ArrayType):
        if isinstance(have.elementType, S.StructType):
            k, v = have.elementType.fields
            pair = lambda e: F.struct(to_wire(e[k.name], k.dataType, bare.args[0]).alias("key"), to_wire(e[v.name], v.dataType, bare.args[1]).alias("value"))
        else:
            pair = lambda e: F.struct(parse_scalar(e[0], bare.args[0]).alias("key"), parse_scalar(e[1], bare.args[1]).alias("value"))
        out = F.map_from_entries(F.transform(c, pair))
    elif isinstance(want, S.StringType) and not isinstance(have, S.StringType):
        out = c.cast("string") if not isinstance(have, (S.ArrayType, S.MapType, S.StructType)) else F.to_json(c)
    elif isinstance(have, S.StringType) and not isinstance(want, S.StringType):
        out = parse_scalar(c, bare)
    elif bare.name == "BFloat16":
        out = brain_float(c)
    elif isinstance(want, (S.ArrayType, S.MapType, S.StructType)) or want == have:
        out = c
    else:
        out = _number(c, have, want)
    if bare.name == "JSON":
        out = json_document(out, bare.args)
    if bare.name in ("IPv4", "IPv6"):
        out = address(out, int(bare.name[3]))
    if bare.name in ("Enum8", "Enum16") and bare.args:
        labels = [a[0] if isinstance(a, tuple) else a for a in bare.args]
        out = F.when(out.isNull() | out.isin(*labels), out).otherwise(F.raise_error(F.concat(F.lit("Unknown element '"), out, F.lit(f"' for enum {bare.name}"))).cast("string"))
    return out if t.nullable else F.coalesce(out, default_of(t))


def _number(c: Column, have: S.DataType, want: S.DataType) -> Column:
    """Between scalars: halves go to the even number from binary fractions, away from zero from decimal ones."""
    if isinstance(want, (S.ByteType, S.ShortType, S.IntegerType, S.LongType)):
        if isinstance(have, (S.FloatType, S.DoubleType)):
            c = F.rint(c)
        elif isinstance(have, S.DecimalType) and have.scale:
            c = F.round(c, 0)
    if isinstance(want, S.BooleanType) and not isinstance(have, S.BooleanType):
        return c != 0
    if isinstance(want, S.DecimalType) and isinstance(have, (S.FloatType, S.DoubleType)):
        c = c.cast("string")
    return c.cast(want)


def _width(logical: str) -> tuple[str, list[int]]:
    found = re.fullmatch(r"([a-z ]+?)\s*(?:\(([\d,\s]+)\))?(\s+with time zone)?", logical.rstrip("[]"))
    return (found[1].strip(), [int(x) for x in (found[2] or "").split(",") if x.strip()]) if found else (logical, [])


def to_column(c: Column, t: FileType, field: S.StructField, check: str = "fail") -> Column:
    """A file's value as the table's column, its length or digits applied anew, to array elements too."""
    return _to(c, t.plain, field.dataType, logical_type(field), check)


def _to(c: Column, t: FileType, want: S.DataType, logical: str, check: str) -> Column:
    have = wire_type(t)
    if t.name in GEO and not isinstance(want, S.StringType):
        if logical == "lseg":
            return F.when(c.isNotNull() & (F.size(c) != 2), F.raise_error(F.lit("a segment requires exactly two points")).cast(want)).otherwise(c)
        return c
    if t.name in ("Tuple", "Map", "Nested"):
        return _from_composite(c, t, want, logical, check)
    if isinstance(have, S.ArrayType) and isinstance(want, S.ArrayType):
        inner = t.args[0].plain if t.name == "Array" else geo_as_nested(t).args[0]
        return F.transform(c, lambda x: _to(x, inner, want.elementType, logical.removesuffix("[]"), check))
    base, digits = _width(logical)
    if isinstance(want, S.BinaryType):
        return c.cast("binary")
    if isinstance(want, S.StringType):
        if base in ("time",) and isinstance(have, S.TimestampType):
            zone = next((a for a in t.args if isinstance(a, str)), "UTC")
            utc = F.to_utc_timestamp(c, F.current_timezone())
            return F.date_format(F.from_utc_timestamp(utc, zone), "HH:mm:ss")
        text = literal(c, t, within=False) if nested(t) else c if isinstance(have, S.StringType) else scalar_text(c, t)
        if t.name == "JSON":
            text = json_document(text, t.args)
        if t.name in ("IPv4", "IPv6"):
            text = address(text, int(t.name[3]))
        if t.name == "FixedString":
            text = F.rtrim(text, F.lit("\0"))
        if isinstance(have, S.StringType) and t.name in ("String", "FixedString"):
            text = check_text(text, check)
        if base == "jsonb":
            return binary_json(text)
        if base in ("char", "bpchar", "character") and digits:
            long = F.raise_error(F.lit(f"value too long for type character({digits[0]})")).cast("string")
            text = F.when(F.length(F.rtrim(text)) > digits[0], long).otherwise(F.rpad(F.rtrim(text), digits[0], " "))
        if base in ("varchar", "character varying") and digits:
            text = F.when(F.length(text) > digits[0], F.raise_error(F.lit(f"value too long for type character varying({digits[0]})")).cast("string")).otherwise(text)
        return text
    if isinstance(have, S.StringType):
        return _parse(c, want)
    if t.name.startswith("Interval") and isinstance(want, (S.ShortType, S.IntegerType, S.LongType)):
        return interval_units(c, t.name[8:]).cast(want)
    if isinstance(want, (S.TimestampType, S.TimestampNTZType)):
        out = c.cast(want)
        if base == "timestamp" and digits and digits[0] < 6:
            unit = 10 ** (6 - digits[0])
            micros = F.round(F.unix_micros(out.cast("timestamp")) / unit, 0).cast("long") * unit
            out = F.timestamp_micros(micros).cast(want)
        return out
    return _number(c, have, want)


def _parse(c: Column, want: S.DataType) -> Column:
    """Text as another type, as the type's own input reads it."""
    kinds = {S.ShortType: "Int16", S.IntegerType: "Int32", S.LongType: "Int64", S.FloatType: "Float32", S.DoubleType: "Float64", S.BooleanType: "Bool", S.DateType: "Date32", S.TimestampType: "DateTime64"}
    if isinstance(want, S.ArrayType):
        return F.from_json(c, want)
    if isinstance(want, S.StructType):
        return F.from_json(c, want)
    if isinstance(want, S.TimestampNTZType):
        return c.cast(want)
    return parse_scalar(c, FileType(kinds[type(want)])).cast(want) if type(want) in kinds else F.trim(c).cast(want)


def _from_composite(c: Column, t: FileType, want: S.DataType, logical: str, check: str) -> Column:
    """Tuples, maps and nested rows: to structs by position, to arrays of structs, to arrays of text, or to text."""
    if t.name == "Nested":
        t = FileType("Array", (FileType("Tuple", t.args, t.fields),))
        if isinstance(want, S.ArrayType):
            return F.transform(c, lambda x: _to(x, t.args[0], want.elementType, logical.removesuffix("[]"), check))
        return F.to_json(c)
    if t.name == "Map":
        if isinstance(want, S.MapType):
            return c
        pair = FileType("Tuple", t.args, ("key", "value"))
        if isinstance(want, S.ArrayType):
            return F.transform(F.map_entries(c), lambda e: _to(e, pair, want.elementType, logical.removesuffix("[]"), check))
        return literal(c, t, within=False)
    names = t.fields or [str(i + 1) for i in range(len(t.args))]
    if isinstance(want, S.StructType):
        if len(want.fields) != len(names):
            raise ValueError(f"could not map tuple to returned type: it has {len(names)} values, the type has {len(want.fields)}")
        parts = [_to(c[n], a.plain, f.dataType, logical_type(f), check).alias(f.name) for n, a, f in zip(names, t.args, want.fields, strict=True)]
        return F.when(c.isNotNull(), F.struct(*parts))
    if isinstance(want, S.ArrayType):
        parts = [_to(c[n], a.plain, want.elementType, logical.removesuffix("[]"), check) for n, a in zip(names, t.args, strict=True)]
        return F.when(c.isNotNull(), F.array(*parts))
    return literal(c, t, within=False)
