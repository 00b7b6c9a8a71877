"""Options of a copy, and the engine's settings, with their checks."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

ENCODING_CHECKS = ("fail", "truncate", "remove", "replace")
#: Names of compressions -> the codec's canonical name.
COMPRESSIONS = {"auto": "auto", "none": "none", "gzip": "gzip", "gz": "gzip", "brotli": "brotli", "br": "brotli", "xz": "xz", "lzma": "xz", "zstd": "zstd", "zst": "zstd", "lz4": "lz4", "bz2": "bz2", "snappy": "snappy"}
SUFFIXES = {".gz": "gzip", ".br": "brotli", ".xz": "xz", ".lzma": "xz", ".zst": "zstd", ".zstd": "zstd", ".lz4": "lz4", ".bz2": "bz2", ".snappy": "snappy"}


@dataclass(frozen=True)
class CopyOptions:
    format: str = "auto"
    structure: str | None = None
    access_key: str | None = None
    access_secret: str | None = None
    session_token: str | None = None
    compression: str = "auto"
    timeout: int = 30_000
    encoding_check: str = "fail"

    def redacted(self) -> CopyOptions:
        """For logs."""
        hide = lambda v: "***" if v else v
        return replace(self, access_key=hide(self.access_key), access_secret=hide(self.access_secret), session_token=hide(self.session_token))


def copy_options(**given) -> CopyOptions:
    known = CopyOptions.__dataclass_fields__
    for name in given:
        if name not in known:
            raise ValueError(f'option "{name}" not supported')
    out = {k: v for k, v in given.items() if v is not None}
    if "timeout" in out:
        try:
            out["timeout"] = int(out["timeout"])
        except (TypeError, ValueError):
            out["timeout"] = -1
        if not 0 <= out["timeout"] < 1 << 32:
            raise ValueError('argument to COPY option "timeout" must be a uint32')
    if "encoding_check" in out:
        value = str(out["encoding_check"]).lower()
        if value not in ENCODING_CHECKS:
            raise ValueError(f'invalid value for option "encoding_check": "{out["encoding_check"]}" (hint: use one of fail, truncate, remove, replace)')
        out["encoding_check"] = value
    if "compression" in out:
        value = COMPRESSIONS.get(str(out["compression"]).lower())
        if value is None:
            raise ValueError(f'invalid value for option "compression": "{out["compression"]}"')
        out["compression"] = value
    if "structure" in out:
        out["structure"] = re.sub(r"[\r\n]", " ", out["structure"])
    return CopyOptions(**out)


def codec_of(path: str, compression: str) -> str:
    """The codec of a file: as named, or by its last suffix."""
    if compression != "auto":
        return compression
    return next((c for s, c in SUFFIXES.items() if path.lower().endswith(s)), "none")


def bare_name(path: str) -> str:
    """The path without the suffix of a compression."""
    for s in SUFFIXES:
        if path.lower().endswith(s):
            return path[: -len(s)]
    return path


@dataclass(frozen=True)
class Settings:
    """Limits, 0 for what the session has: memory is advisory, threads bound a query's shuffle partitions, parsing threads the tasks of a copy into a table."""

    max_memory: int = 0
    max_threads: int = 0
    max_parsing_threads: int = 0

    def __post_init__(self):
        for name, unit in (("max_memory", " MB"), ("max_threads", ""), ("max_parsing_threads", "")):
            value = getattr(self, name)
            if not 0 <= value <= 65535:
                raise ValueError(f'{value}{unit} is outside the valid range for parameter "{name}" (0{unit} .. 65535{unit})')
