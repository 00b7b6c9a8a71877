"""URLs: schemes, the normal form of each object store's addresses, and path patterns."""

from __future__ import annotations

import fnmatch
import re
from dataclasses import dataclass, field
from urllib.parse import urlsplit

from pyspark.sql import SparkSession

from lakeferry.plans.options import CopyOptions

#: Scheme -> kind of store.
SCHEMES = {"file": "file", "http": "http", "https": "http", "s3": "s3", "gs": "gcs", "gcs": "gcs", "oss": "gcs", "az": "azure", "azure": "azure", "abfs": "azure", "abfss": "azure", "hdfs": "hdfs"}


@dataclass(frozen=True)
class Location:
    """``kind`` of store, the ``address`` in its normal form, the ``path`` that Spark reads, and the Hadoop settings it needs."""

    kind: str
    address: str
    path: str
    conf: dict[str, str | None] = field(default_factory=dict)
    account: str = ""
    container: str = ""


def scheme_of(url: str) -> str | None:
    """The store's kind, or None: what stands before ``://``, by exact case."""
    head, sep, _ = url.partition("://")
    return SCHEMES.get(head) if sep else None


def locate(url: str, options: CopyOptions | None = None) -> Location:
    options = options or CopyOptions()
    kind = scheme_of(url)
    if kind is None:
        raise ValueError(f'cannot read URL "{url}"')
    rest = url.partition("://")[2]
    if kind == "file":
        if not rest.startswith("/"):
            raise ValueError("relative path not allowed for COPY to file URL")
        return Location(kind, rest, "file://" + rest)
    if kind == "http":
        return Location(kind, url, url, {"seconds": str(-(-options.timeout // 1000))})
    if kind == "hdfs":
        return Location(kind, url, url)
    if kind == "s3":
        return _s3(rest, options)
    if kind == "gcs":
        return _gcs(rest, options)
    return _azure(url.partition("://")[0], rest, options)


def _credentials(options: CopyOptions, bucket: str, endpoint: str | None, token: bool) -> dict[str, str | None]:
    """Settings of one bucket, so that no other call's requests are signed by them; those that must not be left from an earlier call are None.

    Without a key requests are anonymous; a key without a secret has an empty one.
    """
    of, aws = f"fs.s3a.bucket.{bucket}.", "org.apache.hadoop.fs.s3a."
    session = options.session_token if token and options.access_key else None
    provider = "AnonymousAWSCredentialsProvider" if not options.access_key else "TemporaryAWSCredentialsProvider" if session else "SimpleAWSCredentialsProvider"
    secret = (options.access_secret or "") if options.access_key else None
    return {
        of + "aws.credentials.provider": aws + provider,
        of + "access.key": options.access_key,
        of + "secret.key": secret,
        of + "session.token": session,
        of + "endpoint": endpoint,
        of + "connection.timeout": str(options.timeout),
        "fs.s3a.impl.disable.cache": "true",  # a client kept from an earlier call has that call's keys
    }


def _s3(rest: str, options: CopyOptions) -> Location:
    host, _, path = rest.partition("/")
    found = re.fullmatch(r"(.+)\.(s3[.-][a-z0-9-]+\.amazonaws\.com|s3\.amazonaws\.com)", host)
    if found:
        return Location("s3", f"https://{rest}", f"s3a://{found[1]}/{path}", _credentials(options, found[1], found[2], True))
    return Location("s3", f"s3://{rest}", f"s3a://{rest}", _credentials(options, host, None, True))


def _gcs(rest: str, options: CopyOptions) -> Location:
    """The store's interface for access keys is the other one's, at an address of its own."""
    host = "storage.googleapis.com"
    rest = rest.removeprefix(host + "/")
    bucket = rest.partition("/")[0]
    return Location("gcs", f"https://{host}/{rest}", f"s3a://{rest}", _credentials(options, bucket, f"https://{host}", False) | {f"fs.s3a.bucket.{bucket}.path.style.access": "true"})


def _azure(scheme: str, rest: str, options: CopyOptions) -> Location:
    path, _, query = rest.partition("?")
    if scheme.startswith("abfs"):
        container, at, tail = path.partition("@")
        if not at:
            raise ValueError("Azure ABFS URL missing the container part")
        host, _, blob = tail.partition("/")
        if "." not in host:
            host += ".blob.core.windows.net"
    else:
        host, _, tail = path.partition("/")
        if "." not in host:
            raise ValueError("Azure URL missing the storage account host")
        container, _, blob = tail.partition("/")
    if not container:
        raise ValueError("Azure URL missing the container name")
    account = host.split(".")[0]
    conf = {f"fs.azure.account.key.{host}": options.access_secret or ""} if options.access_key else {}
    if query:
        conf[f"fs.azure.sas.{container}.{host}"] = query
    address = f"https://{host}" + (f"?{query}" if query else "")
    return Location("azure", address, f"wasbs://{container}@{host}/{blob}", conf, options.access_key or account, container)


def expand_ranges(pattern: str, limit: int = 100_000) -> str:
    """``{3..12}`` as ``{3,...,12}``, the zeros in front kept; other braces stay."""

    def spread(m: re.Match) -> str:
        low, high = int(m[1]), int(m[2])
        if high < low or high - low >= limit:
            raise ValueError(f"range {m[0]} is empty or too wide")
        width = len(m[1]) if m[1].startswith("0") and len(m[1]) > 1 else 0
        return "{" + ",".join(str(i).zfill(width) for i in range(low, high + 1)) + "}"

    return re.sub(r"\{(\d+)\.\.(\d+)\}", spread, pattern)


def has_pattern(path: str) -> bool:
    return bool(re.search(r"[*?{]", path))


def _braces(pattern: str) -> list[str]:
    """All strings that a pattern with alternatives stands for."""
    found = re.search(r"\{([^{}]*)\}", pattern)
    if not found:
        return [pattern]
    return [x for part in found[1].split(",") for x in _braces(pattern[: found.start()] + part + pattern[found.end() :])]


def list_files(spark: SparkSession, location: Location) -> list[str]:
    """Files that a location's pattern names, in order. ``**`` matches files at any depth; a folder stands for what lies right in it."""
    pattern = expand_ranges(location.path)
    if location.kind == "http":
        return _braces(pattern)
    jvm = spark._jvm
    path_of = jvm.org.apache.hadoop.fs.Path
    fs = path_of(re.split(r"[*?{]", pattern)[0] or pattern).getFileSystem(spark._jsc.hadoopConfiguration())
    out: list[str] = []
    for one in _braces(pattern) if "**" in pattern else [pattern]:
        if "**" in one:
            head, _, tail = one.partition("**")
            root = path_of(head.rsplit("/", 1)[0] or "/")
            if fs.exists(root):
                files = fs.listFiles(root, True)
                while files.hasNext():
                    p = files.next().getPath().toString()
                    if fnmatch.fnmatchcase(urlsplit(p).path, urlsplit(head).path + "*" + tail.lstrip("/")):
                        out.append(p)
            continue
        statuses = fs.globStatus(path_of(one)) if has_pattern(one) else ([fs.getFileStatus(path_of(one))] if fs.exists(path_of(one)) else [])
        for status in statuses or []:
            if status.isDirectory():
                out += [s.getPath().toString() for s in fs.listStatus(status.getPath()) if s.isFile() and s.getPath().getName()[0] not in "._"]
            else:
                out.append(status.getPath().toString())
    if not out:
        raise FileNotFoundError(f"no file matches {location.address}")
    return sorted(dict.fromkeys(out))
