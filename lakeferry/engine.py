"""The engine: one object with all entry points."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as S

from lakeferry import __version__
from lakeferry.operators import copy, create, query
from lakeferry.plans import catalog
from lakeferry.plans.options import Settings, copy_options
from lakeferry.types.grammar import render_structure

_OPTIONS = ("format", "structure", "access_key", "access_secret", "session_token", "compression", "timeout", "encoding_check")


class Engine:
    """All entry points over one session. ``allow_files`` False refuses local files, ``read_only`` True whatever writes a table.

    ``policy(action, what)`` may forbid anything by returning False: "query" a text, "read" or "write" a URL, "select" from, "insert" into or "create" a table.
    """

    def __init__(self, spark: SparkSession, *, max_memory: int = 0, max_threads: int = 0, max_parsing_threads: int = 0, allow_files: bool = True, read_only: bool = False, policy: Callable[[str, str], bool] | None = None):
        self.spark = spark
        self.settings = Settings(max_memory, max_threads, max_parsing_threads)
        self.allow_files, self.read_only, self.policy = allow_files, read_only, policy
        self._tag = f"lakeferry-{uuid.uuid4().hex}"

    @contextmanager
    def _cancellable(self) -> Iterator[None]:
        context = self.spark.sparkContext
        context.addJobTag(self._tag)
        context.setInterruptOnCancel(True)  # so that tasks end too
        try:
            yield
        finally:
            context.removeJobTag(self._tag)

    def cancel(self) -> None:
        """Stop the copies that run on this engine now, from another thread. What they staged goes with them."""
        self.spark.sparkContext.cancelJobsWithTag(self._tag)

    def _allow(self, action: str, what: str) -> None:
        if self.policy is not None and self.policy(action, what) is False:
            raise PermissionError(f"permission denied to {action} {what}")

    def _writable(self, what: str) -> None:
        if self.read_only:
            raise PermissionError(f"cannot execute {what} in a read-only transaction")

    def version(self) -> str:
        return __version__

    def _permit(self, url: str, way: str) -> None:
        if url.startswith("file://") and not self.allow_files:
            raise PermissionError(f"permission denied to COPY {way} a file")
        self._allow("read" if way == "from" else "write", url)

    def query(self, sql: str, schema: str | S.StructType | None = None, params: dict | None = None) -> DataFrame:
        """Rows of a query in an isolated session, as the declared columns."""
        self._allow("query", sql)
        return query.query(self.spark, sql, schema, params, self.settings, self.version(), lambda url: self._permit(url, "from"))

    def copy_from(self, table: str, url: str, *, columns: list[str] | None = None, unique: list[str] | None = None, where: str | None = None, **options) -> int:
        if where is not None:
            raise ValueError("COPY FROM a URL not supported with a WHERE clause")
        self._writable("COPY FROM")
        self._permit(url, "from")
        self._allow("insert", table)
        with self._cancellable():
            return copy.copy_from(self.spark, table, url, copy_options(**options), columns, unique=unique, threads=self.settings.max_parsing_threads)

    def copy_into_parts(self, parts: dict[str, str], url: str, *, columns: list[str] | None = None, **options) -> int:
        self._writable("COPY FROM")
        self._permit(url, "from")
        for table in parts:
            self._allow("insert", table)
        with self._cancellable():
            return copy.copy_into_parts(self.spark, parts, url, copy_options(**options), columns)

    def copy_to(self, source: str | DataFrame, url: str, *, columns: list[str] | None = None, single_file: bool = True, **options) -> int:
        self._permit(url, "to")
        with self._cancellable():
            if isinstance(source, str):
                self._allow("select", source)
                return copy.copy_to(self.spark.table(source), url, copy_options(**options), columns, catalog.table_schema(self.spark, source), single_file)
            return copy.copy_to(source, url, copy_options(**options), columns, None, single_file)

    def read(self, url: str, schema: str | S.StructType | None = None, **options) -> DataFrame:
        """A file's rows without a table: as inferred columns, or the declared ones."""
        self._permit(url, "from")
        given = copy_options(**options)
        if schema is None:
            columns = create.describe(self.spark, url, given)
            from lakeferry.types.mapping import column_field

            want = S.StructType([column_field(n, t) for n, t in columns])
            given = copy_options(**{k: v for k, v in {**options, "structure": render_structure(columns)}.items() if k in _OPTIONS})
        else:
            want = catalog.parse_columns(schema) if isinstance(schema, str) else schema
        return copy.read_rows(self.spark, copy.request(self.spark, want, url, given, None))

    def create_table(self, name: str, columns: str | S.StructType | None = None, *, structure_from: str | None = None, copy_from: str | None = None, if_not_exists: bool = False, **options) -> int:
        self._writable("CREATE TABLE")
        self._allow("create", name)
        for url in (structure_from, copy_from):
            if url:
                self._permit(url, "from")
        properties = {k: str(v) for k, v in options.items() if k not in _OPTIONS}
        for k in properties:
            if k not in ("fillfactor",):
                raise ValueError(f'unrecognized parameter "{k}"')
        return create.create_table(self.spark, name, columns, structure_from, copy_from, copy_options(**{k: v for k, v in options.items() if k in _OPTIONS}), properties, if_not_exists)

    def describe(self, url: str, **options) -> list[tuple[str, str]]:
        from lakeferry.types.grammar import render_type

        self._permit(url, "from")
        return [(n, render_type(t)) for n, t in create.describe(self.spark, url, copy_options(**options))]

    def sql(self, text: str):
        """``COPY t [(a, b)] FROM|TO 'url' [(option value, ...)]`` and ``CREATE TABLE t [(columns)] WITH (structure_from|copy_from = 'url', ...)``; anything else is Spark's."""
        # literals stand aside, so that parentheses and keywords in them are not seen
        bare, held = query.masked(text)
        whole = lambda part: query.unmasked(part, held) if part else None
        name = "((?:[\\w.]|\0\\d+\0)+)"
        m = re.fullmatch(rf"\s*COPY\s+{name}\s*(?:\(([^)]*)\))?\s+(FROM|TO)\s+(\0\d+\0)\s*(?:WITH\s*)?(?:\((.*?)\))?\s*(WHERE\b.*)?;?\s*", bare, re.I | re.S)
        if m:
            table, url, columns = whole(m[1]), whole(m[4])[1:-1].replace("''", "'"), None
            if m[2]:
                columns = [c.strip()[1:-1] if c.strip()[:1] in "\"`" else c.strip() for c in map(whole, m[2].split(","))]
            options = {k.lower(): v for k, v in _pairs(m[5] or "", held)}
            if m[3].upper() == "TO":
                return self.copy_to(table, url, columns=columns, **options)
            return self.copy_from(table, url, columns=columns, where=whole(m[6]), **options)
        m = re.fullmatch(rf"\s*CREATE\s+TABLE\s+(IF\s+NOT\s+EXISTS\s+)?{name}\s*(?:\((.*?)\))?\s*WITH\s*\((.*)\)\s*;?\s*", bare, re.I | re.S)
        if m and re.search(r"\b(structure_from|copy_from)\b", m[4], re.I):
            options = {k.lower(): v for k, v in _pairs(m[4], held)}
            return self.create_table(whole(m[2]), whole(m[3]), if_not_exists=bool(m[1]), **options)
        return self.spark.sql(text)


def _pairs(text: str, held: list[str]) -> list[tuple[str, str]]:
    """Names and values of options; literals are numbers of ``held`` between marks. What is no option raises."""
    out, at = [], 0
    for m in re.finditer("\\s*(\\w+)\\s*=?\\s*(?:\0(\\d+)\0|([\\w.]+))\\s*(?:,|$)", text):
        if m.start() != at:
            break
        out.append((m[1], held[int(m[2])][1:-1].replace("''", "'") if m[2] else m[3]))
        at = m.end()
    if text[at:].strip():
        raise ValueError(f"cannot read the options at {query.unmasked(text[at:].strip(), held)[:80]!r}")
    return out
