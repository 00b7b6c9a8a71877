"""Text forms of values, both ways, as column expressions.

Scalars of a delimited file are written and read by built-in functions alone. Arrays, tuples and maps within a cell are literals
``[..]``, ``(..)``, ``{k:v}``; they are written by higher-order functions, and read by one Arrow function that turns a literal into JSON.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

from lakeferry.types.grammar import FileType
from lakeferry.types.mapping import GEO, MONTH_UNITS, TIME_UNITS, wire_type

#: Escapes of tab-separated text.
ESCAPES = [("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"), ("\b", "\\b"), ("\f", "\\f"), ("\0", "\\0"), ("'", "\\'")]
UNESCAPES = [("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ("\\b", "\b"), ("\\f", "\f"), ("\\0", "\0"), ("\\'", "'"), ("\\a", "\a"), ("\\v", "\v")]
_HOLD = "\ue000\ue001"


def escape(c: Column) -> Column:
    for raw, text in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(text))
    return c


def unescape(c: Column) -> Column:
    """Escapes of one character; ``\\xHH`` only where a cell has one, so the rest stays with plain replacements."""
    out = F.replace(c, F.lit("\\\\"), F.lit(_HOLD))
    for text, raw in UNESCAPES:
        out = F.replace(out, F.lit(text), F.lit(raw))
    hexed = F.when(out.contains("\\x"), _unhex(out)).otherwise(out)
    return F.when(c.contains("\\"), F.replace(hexed, F.lit(_HOLD), F.lit("\\"))).otherwise(c)


def _unhex(c: Column) -> Column:
    parts = F.split(c, "\\\\x(?=[0-9A-Fa-f]{2})")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.chr(F.conv(F.substring(p, 1, 2), 16, 10).cast("int")), F.substring(p, 3, 1 << 30)))
    return F.concat(F.element_at(parts, 1), F.array_join(rest, ""))


def precision(t: FileType) -> int:
    return t.args[0] if t.args and isinstance(t.args[0], int) else 3


def instant_text(c: Column, t: FileType) -> Column:
    """ISO 8601 in UTC; a type's precision cuts off digits."""
    utc = F.to_utc_timestamp(c.cast("timestamp"), F.current_timezone()).cast("timestamp_ntz")
    digits = 0 if t.name == "DateTime" else min(precision(t), 6)
    pattern = "yyyy-MM-dd'T'HH:mm:ss" + ("." + "S" * digits if digits else "")
    return F.concat(F.date_format(utc, pattern), F.lit("Z"))


def interval_units(c: Column, unit: str) -> Column:
    """Whole units of an interval; one that isn't whole raises."""
    if unit in MONTH_UNITS:
        months = F.extract(F.lit("YEAR"), c).cast("long") * 12 + F.extract(F.lit("MONTH"), c).cast("long")
        n, size = months, MONTH_UNITS[unit]
    else:
        day = lambda part: F.extract(F.lit(part), c).cast("long") if part != "SECOND" else F.extract(F.lit(part), c)
        micros = ((day("DAY") * 24 + day("HOUR")) * 60 + day("MINUTE")).cast("long") * 60_000_000 + (day("SECOND") * 1_000_000).cast("long")
        if unit == "Nanosecond":
            return micros * 1000
        n, size = micros, TIME_UNITS[unit] // 1000
    return F.when(c.isNotNull() & (n % size != 0), F.raise_error(F.lit(f"interval does not fit Interval{unit}")).cast("long")).otherwise(F.floor(n / size).cast("long"))


def units_interval(c: Column, unit: str) -> Column:
    n = c.cast("long")
    if unit in MONTH_UNITS:
        months = F.when(F.abs(n) > 178_000_000 * 12 // MONTH_UNITS[unit], F.raise_error(F.lit(f"Interval{unit} value out of range")).cast("long")).otherwise(n * MONTH_UNITS[unit])
        return F.make_ym_interval(F.lit(0), months.cast("int"))
    seconds = F.lit(TIME_UNITS[unit]).cast("decimal(20,0)") * n.cast("decimal(38,0)") / 1_000_000_000 if unit not in ("Nanosecond",) else (F.signum(n) * F.floor(F.abs(n) / 1000)).cast("decimal(38,6)") / 1_000_000
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def scalar_text(c: Column, t: FileType) -> Column:
    """A scalar's text, without quotes or escapes."""
    if t.name in ("DateTime", "DateTime64"):
        return instant_text(c, t)
    if t.name in ("Float32", "Float64", "BFloat16"):
        return F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").otherwise(c.cast("string"))
    if t.name.startswith("Interval"):
        return interval_units(c, t.name[8:]).cast("string")
    return c.cast("string")


def brain_float(c: Column) -> Column:
    """A number with the upper 16 bits of its single-precision form: the sign, the exponent and seven digits after the point, the others cut off."""
    x = c.cast("float").cast("double")
    size = F.abs(x)
    guess = F.floor(F.log2(size))
    two = lambda e: F.pow(F.lit(2.0), e.cast("double"))
    exponent = F.greatest(F.when(two(guess) > size, guess - 1).when(two(guess + 1) <= size, guess + 1).otherwise(guess), F.lit(-126))
    unit = two(exponent - 7)
    cut = F.signum(x) * F.floor(size / unit) * unit
    return F.when((size == 0) | F.isnan(x) | (size == float("inf")), x).otherwise(cut).cast("float")


def parse_scalar(c: Column, t: FileType) -> Column:
    """The value of a scalar's text."""
    t = t.plain
    kind = wire_type(t)
    if t.name == "BFloat16":
        return brain_float(c)
    if isinstance(kind, (S.FloatType, S.DoubleType)):
        return c.cast(kind)  # which knows nan and inf by any case
    if isinstance(kind, S.BooleanType):
        return F.when(F.lower(c).isin("true", "1"), True).when(F.lower(c).isin("false", "0"), False).otherwise(c.cast("boolean"))
    if isinstance(kind, S.TimestampType):
        zone = next((a for a in t.args if isinstance(a, str)), "UTC")
        has_zone = c.rlike("(Z|[+-]\\d\\d:?\\d\\d)$")
        local = F.replace(c, F.lit("T"), F.lit(" "))
        return F.when(c.endswith("Z"), c).when(has_zone, c).otherwise(F.concat(local, F.lit(" " + zone))).cast("timestamp")
    if isinstance(kind, S.DateType):
        return c.cast("date")
    if t.name.startswith("Interval"):
        return units_interval(c, t.name[8:])
    if t.name == "UUID":
        return F.lower(c)
    return c if isinstance(kind, S.StringType) else F.trim(c).cast(kind)


QUOTED = {"String", "FixedString", "Enum8", "Enum16", "UUID", "Date", "Date32", "DateTime", "DateTime64", "Time", "Time64", "IPv4", "IPv6", "JSON"}


def nested(t: FileType) -> bool:
    return t.plain.name in ("Array", "Map", "Tuple", "Nested") or t.plain.name in GEO


def geo_as_nested(t: FileType) -> FileType:
    """Points are tuples of two numbers, lines and rings arrays of points, and so on."""
    point = FileType("Tuple", (FileType("Float64"), FileType("Float64")), ("x", "y"))
    depth = {"Point": 0, "LineString": 1, "Ring": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}[t.name]
    for _ in range(depth):
        point = FileType("Array", (point,))
    return point


def literal(c: Column, t: FileType, within: bool = True) -> Column:
    """The text of a value as it stands inside another: text in quotes, nulls as NULL."""
    bare = t.plain
    if bare.name in GEO:
        bare = geo_as_nested(bare)
    if bare.name == "Array":
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: literal(x, bare.args[0])), ","), F.lit("]"))
    elif bare.name == "Nested":
        one = FileType("Tuple", bare.args, bare.fields)
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: literal(x, one)), ","), F.lit("]"))
    elif bare.name == "Tuple":
        names = bare.fields or [str(i + 1) for i in range(len(bare.args))]
        text = F.concat(F.lit("("), F.concat_ws(",", *[literal(c[n], a) for n, a in zip(names, bare.args, strict=True)]), F.lit(")"))
    elif bare.name == "Map":
        pair = lambda e: F.concat(literal(e["key"], bare.args[0]), F.lit(":"), literal(e["value"], bare.args[1]))
        text = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(c), pair), ","), F.lit("}"))
    elif bare.name in QUOTED:
        text = F.concat(F.lit("'"), escape(scalar_text(c, bare)), F.lit("'"))
    else:
        text = scalar_text(c, bare)
    return F.coalesce(text, F.lit("NULL")) if within else text


class _Literal:
    """Reads a literal of known type into what ``json.dumps`` takes: tuples as objects, maps as lists of key and value."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def space(self):
        while self.at < len(self.text) and self.text[self.at] in " \t\n":
            self.at += 1

    def need(self, c: str):
        self.space()
        if self.text[self.at : self.at + 1] != c:
            raise ValueError(f"cannot parse {self.text[:80]!r}: expected {c} at {self.at}")
        self.at += 1

    def items(self, open_: str, close: str, one: Callable):
        self.need(open_)
        out = []
        self.space()
        while self.text[self.at : self.at + 1] != close:
            out.append(one(len(out)))
            self.space()
            if self.text[self.at : self.at + 1] == ",":
                self.at += 1
                self.space()
        self.at += 1
        return out

    def value(self, t: FileType):
        t = t.plain
        if t.name in GEO:
            t = geo_as_nested(t)
        self.space()
        if self.text.startswith("NULL", self.at):
            self.at += 4
            return None
        if t.name == "Array":
            return self.items("[", "]", lambda _: self.value(t.args[0]))
        if t.name == "Nested":
            return self.items("[", "]", lambda _: self.value(FileType("Tuple", t.args, t.fields)))
        if t.name == "Tuple":
            names = t.fields or [str(i + 1) for i in range(len(t.args))]
            got = self.items("(", ")", lambda i: self.value(t.args[i]))
            return dict(zip(names, got, strict=True))
        if t.name == "Map":

            def pair(_):
                key = self.value(t.args[0])
                self.need(":")
                return {"key": key, "value": self.value(t.args[1])}

            return self.items("{", "}", pair)
        if self.text[self.at : self.at + 1] in ("'", '"'):
            return self.string(self.text[self.at])
        start = self.at
        while self.at < len(self.text) and self.text[self.at] not in ",)]}:":
            self.at += 1
        return self.text[start : self.at].strip()

    def string(self, end: str) -> str:
        self.at += 1
        out = []
        while True:
            c = self.text[self.at]
            self.at += 1
            if c == "\\":
                n = self.text[self.at]
                self.at += 1
                if n == "x":
                    out.append(chr(int(self.text[self.at : self.at + 2], 16)))
                    self.at += 2
                else:
                    out.append({"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", "0": "\0", "a": "\a", "v": "\v"}.get(n, n))
            elif c == end:
                if self.text[self.at : self.at + 1] == end:
                    self.at += 1
                    out.append(end)
                    continue
                return "".join(out)
            else:
                out.append(c)


def read_literal(text: str, t: FileType):
    return _Literal(text).value(t)


def text_type(t: FileType) -> S.DataType:
    """As ``wire_type``, with every scalar text and maps as arrays of pairs: the form that literals and JSON are first read into."""
    t = t.plain
    if t.name in GEO:
        t = geo_as_nested(t)
    if t.name == "Array":
        return S.ArrayType(text_type(t.args[0]))
    if t.name == "Map":
        return S.ArrayType(S.StructType([S.StructField("key", text_type(t.args[0])), S.StructField("value", text_type(t.args[1]))]))
    if t.name in ("Tuple", "Nested"):
        names = t.fields or [str(i + 1) for i in range(len(t.args))]
        of = S.StructType([S.StructField(n, text_type(a)) for n, a in zip(names, t.args, strict=True)])
        return S.ArrayType(of) if t.name == "Nested" else of
    return S.StringType()


def from_text(c: Column, t: FileType) -> Column:
    """Values of ``text_type`` as values of ``wire_type``."""
    bare = t.plain
    if bare.name in GEO:
        bare = geo_as_nested(bare)
    if bare.name == "Array":
        return F.transform(c, lambda x: from_text(x, bare.args[0]))
    if bare.name == "Nested":
        return F.transform(c, lambda x: from_text(x, FileType("Tuple", bare.args, bare.fields)))
    if bare.name == "Tuple":
        names = bare.fields or [str(i + 1) for i in range(len(bare.args))]
        return F.when(c.isNotNull(), F.struct(*[from_text(c[n], a).alias(n) for n, a in zip(names, bare.args, strict=True)]))
    if bare.name == "Map":
        return F.map_from_entries(F.transform(c, lambda e: F.struct(from_text(e["key"], bare.args[0]).alias("key"), from_text(e["value"], bare.args[1]).alias("value"))))
    return parse_scalar(c, bare)


def parse_literal(c: Column, t: FileType) -> Column:
    """A cell with an array, tuple or map."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else json.dumps(_Literal(x).value(t)))

    return from_text(F.from_json(F.pandas_udf(run, "string")(c), text_type(t)), t)


def escapable(t: FileType) -> bool:
    """Whether a cell of the type can hold an escape: numbers, dates and instants can't."""
    kind = wire_type(t)
    return isinstance(kind, (S.StringType, S.BinaryType)) or nested(t)


def parse_cell(c: Column, t: FileType) -> Column:
    return parse_literal(c, t) if nested(t) else parse_scalar(c, t)
