"""JSON documents and network addresses: what a file's JSON type keeps of a document, and the one form of a document or address in a table.

These are Arrow functions over whole columns; each is a closure, so that it travels with the plan.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _split(path: str) -> list[str]:
    """``a.b`` with parts that may stand in backquotes."""
    return [a or b for a, b in re.findall(r"`([^`]*)`|([^.`]+)", path)]


def json_rules(args: tuple) -> tuple[list[tuple[list[str], object]], list[list[str]]]:
    """(typed paths with what a missing one becomes, skipped paths) of a JSON type's arguments. Limits, and skipped patterns, say nothing about values here."""
    typed, skipped = [], []
    for a in args:
        text = str(a).strip()
        if "=" in text or text.upper().startswith("SKIP REGEXP"):
            continue
        if text.upper().startswith("SKIP "):
            skipped.append(_split(text[5:].strip()))
            continue
        path, _, kind = text.rpartition(" ") if not text.endswith(")") else re.match(r"((?:`[^`]*`|\S)+)()\s+(.*)", text).groups()
        zero: object = None if kind.startswith("Nullable") else [] if kind.startswith("Array") else False if kind == "Bool" else 0 if re.match("U?Int|Float|Decimal|BFloat", kind) else ""
        typed.append((_split(path), zero))
    return typed, skipped


def json_document(c: Column, args: tuple = ()) -> Column:
    """A document as a JSON type holds it: an object, without keys of null, without skipped paths, and with its typed paths, missing ones as the type's zero. Keys are in order."""
    typed, skipped = json_rules(args)

    def without_nulls(v):
        return {k: without_nulls(x) for k, x in v.items() if x is not None} if isinstance(v, dict) else v

    def one(text):
        import json

        v = json.loads(text)
        if not isinstance(v, dict):
            raise ValueError("the JSON type holds objects only")
        v = without_nulls(v)
        for path in skipped:
            at = v
            for k in path[:-1]:
                at = at.get(k) if isinstance(at, dict) else None
            if isinstance(at, dict):
                at.pop(path[-1], None)
        for path, zero in typed:
            at = v
            for k in path[:-1]:
                at = at.setdefault(k, {})
            if zero is not None:
                at.setdefault(path[-1], zero)
        return json.dumps(v, separators=(",", ":"), ensure_ascii=False, sort_keys=True)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else one(t))

    return run(c)


def binary_json(c: Column) -> Column:
    """A document in its one form: of equal keys the last, shorter keys first, a space behind colons and commas."""

    def ordered(v):
        if isinstance(v, dict):
            return {k: ordered(v[k]) for k in sorted(v, key=lambda k: (len(k.encode()), k.encode()))}
        return [ordered(x) for x in v] if isinstance(v, list) else v

    def one(text):
        import json
        from decimal import Decimal

        class Number(float):
            """A fraction that keeps its digits."""

            def __new__(cls, text):
                out = super().__new__(cls, text)
                out.text = format(Decimal(text), "f")
                return out

            def __repr__(self):
                return self.text

        found = ordered(json.loads(text, parse_float=Number))
        return write(found, json)

    def write(v, json):
        if isinstance(v, dict):
            return "{" + ", ".join(json.dumps(k, ensure_ascii=False) + ": " + write(x, json) for k, x in v.items()) + "}"
        if isinstance(v, list):
            return "[" + ", ".join(write(x, json) for x in v) + "]"
        return repr(v) if isinstance(v, float) else json.dumps(v, ensure_ascii=False)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else one(t))

    return run(c)


def address(c: Column, version: int) -> Column:
    """A network address in its one form; what is none raises. A mask that covers the whole address goes."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        from ipaddress import IPv4Address, IPv6Address

        kind, whole = (IPv4Address, "/32") if version == 4 else (IPv6Address, "/128")
        return texts.map(lambda t: None if t is None else str(kind(t.strip().removesuffix(whole))))

    return run(c)
