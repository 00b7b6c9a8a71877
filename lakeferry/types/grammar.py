"""File-level type strings: parser, renderer, and the structure string ``name Type, name Type``."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class FileType:
    """``name`` with ``args``: types, integers, or (string) literals; ``fields`` holds the names of a tuple's elements, if it has any."""

    name: str
    args: tuple = field(default=())
    fields: tuple[str, ...] = field(default=())

    @property
    def nullable(self) -> bool:
        return self.name == "Nullable" or (self.name == "LowCardinality" and self.args[0].nullable)

    @property
    def plain(self) -> FileType:
        """The type beneath Nullable, LowCardinality and SimpleAggregateFunction."""
        if self.name in ("Nullable", "LowCardinality"):
            return self.args[0].plain
        if self.name == "SimpleAggregateFunction":
            return self.args[1].plain
        return self


_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "f": "\f"}


def quote_name(name: str) -> str:
    """A column's name as a structure has it: bare if it is a plain identifier, else in backticks."""
    if name.isidentifier() and name.isascii():
        return name
    return "`" + name.replace("\\", "\\\\").replace("`", "\\`") + "`"


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def space(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def peek(self) -> str:
        self.space()
        return self.text[self.at] if self.at < len(self.text) else ""

    def take(self, char: str) -> bool:
        if self.peek() == char:
            self.at += 1
            return True
        return False

    def need(self, char: str) -> None:
        if not self.take(char):
            raise ValueError(f"expected {char!r} at position {self.at} of structure {self.text!r}")

    def quoted(self, end: str) -> str:
        out = []
        while self.at < len(self.text):
            c = self.text[self.at]
            self.at += 1
            if c == "\\" and self.at < len(self.text):
                c = self.text[self.at]
                self.at += 1
                out.append(_ESCAPES.get(c, c))
            elif c == end:
                if end != "'" and self.text[self.at : self.at + 1] == end:
                    self.at += 1
                    out.append(c)
                    continue
                return "".join(out)
            else:
                out.append(c)
        raise ValueError(f"unterminated {end} in structure {self.text!r}")

    def word(self) -> str:
        self.space()
        start = self.at
        while self.at < len(self.text) and (self.text[self.at].isalnum() or self.text[self.at] in "_$"):
            self.at += 1
        return self.text[start : self.at]

    def name(self) -> str | None:
        c = self.peek()
        if c in ("`", '"'):
            self.at += 1
            return self.quoted(c)
        return self.word() or None

    def type(self) -> FileType:
        name = self.word()
        if not name:
            raise ValueError(f"expected a type at position {self.at} of structure {self.text!r}")
        if not self.take("("):
            return FileType(name)
        if name in ("Tuple", "Nested"):
            return self.elements(name)
        args: list = []
        while not self.take(")"):
            args.append(self.argument(name))
            if not self.take(","):
                self.need(")")
                break
        return FileType(name, tuple(args))

    def elements(self, name: str) -> FileType:
        args, fields = [], []
        while not self.take(")"):
            start = self.at
            label = self.name()
            if self.peek() in (",", ")", "("):  # no label: what was read is the type
                self.at = start
                label = None
            args.append(self.type())
            fields.append(label)
            if not self.take(","):
                self.need(")")
                break
        return FileType(name, tuple(args), tuple(fields) if all(f is not None for f in fields) and fields else ())

    def argument(self, owner: str):
        c = self.peek()
        if c == "'":
            self.at += 1
            value: object = self.quoted("'")
            if owner.startswith("Enum") and self.take("="):
                return (value, int(self.number()))
            return (value, None) if owner.startswith("Enum") else value
        if c.isdigit() or c == "-":
            return int(self.number())
        if owner == "JSON":
            start = self.at
            depth = 0
            while self.at < len(self.text) and (depth or self.text[self.at] not in ",)"):
                depth += {"(": 1, ")": -1}.get(self.text[self.at], 0)
                self.at += 1
            return self.text[start : self.at].strip()
        return self.type()

    def number(self) -> str:
        self.space()
        start = self.at
        if self.text[self.at : self.at + 1] == "-":
            self.at += 1
        while self.at < len(self.text) and self.text[self.at].isdigit():
            self.at += 1
        return self.text[start : self.at]


def parse_type(text: str) -> FileType:
    reader = _Reader(text)
    found = reader.type()
    if reader.peek():
        raise ValueError(f"unexpected {reader.text[reader.at :]!r} after type {render_type(found)}")
    return found


def parse_structure(text: str) -> list[tuple[str | None, FileType]]:
    """[(name or None, type)]; line breaks count as spaces."""
    reader = _Reader(text.replace("\n", " ").replace("\r", " "))
    if not reader.peek():
        return []
    tuple_type = _Reader(f"({reader.text})")
    tuple_type.need("(")
    found = tuple_type.elements("Tuple")
    if tuple_type.peek():
        raise ValueError(f"unexpected {tuple_type.text[tuple_type.at : -1]!r} in structure")
    return [(found.fields[i] if found.fields else None, t) for i, t in enumerate(found.args)]


def check_structure(text: str, columns: int) -> list[tuple[str, FileType]]:
    """The structure's columns, all named, as many as are copied."""
    found = parse_structure(text)
    for i, (name, _) in enumerate(found, 1):
        if not name:
            raise ValueError(f"structure column {i} has no name")
    if len(found) != columns:
        raise ValueError(f"structure declares {len(found)} columns, copy has {columns}")
    return found  # type: ignore[return-value]


def render_type(t: FileType) -> str:
    if not t.args:
        return t.name
    parts = []
    for i, a in enumerate(t.args):
        if isinstance(a, FileType):
            parts.append((quote_name(t.fields[i]) + " " if t.fields else "") + render_type(a))
        elif isinstance(a, tuple):
            text = "'" + a[0].replace("\\", "\\\\").replace("'", "\\'") + "'"
            parts.append(text if a[1] is None else f"{text} = {a[1]}")
        elif isinstance(a, str) and t.name != "JSON":
            parts.append("'" + a.replace("\\", "\\\\").replace("'", "\\'") + "'")
        else:
            parts.append(str(a))
    return f"{t.name}({', '.join(parts)})"


def render_structure(columns: list[tuple[str, FileType]]) -> str:
    return ", ".join(f"{quote_name(n)} {render_type(t)}" for n, t in columns)
