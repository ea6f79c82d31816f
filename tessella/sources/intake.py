"""What a file is before it is read: format, compression, encoding and delimiter from its first bytes, and URIs of sources."""

from __future__ import annotations

import codecs
import csv
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import parse_qsl, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources import files

#: Bytes that are looked at.
HEAD = 8192
# First bytes of formats, byte order marks, and delimiters that are tried.
MAGIC = [(b"\x1f\x8b", "gzip"), (b"PK\x03\x04", "zip"), (b"PAR1", "parquet"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "excel"), (b"SQLite format 3\x00", "sqlite")]
BOMS = [(codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")]
DELIMITERS = ",\t;|:"
SCHEMES = {"s3": "s3", "s3a": "s3", "minio": "s3", "abfss": "adls", "abfs": "adls", "gs": "gcs", "snowflake": "snowflake", "postgresql": "postgresql", "postgres": "postgresql", "file": "file", "": "file"}


class EmptyFile(ValueError):
    """The file has no bytes."""


class UnsupportedEncoding(ValueError):
    """The text can't be decoded."""


def head(spark: SparkSession, path: str, size: int = HEAD) -> tuple[bytes, int]:
    """The first bytes of a file and its size, by Hadoop's file systems; the rest isn't read."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise FileNotFoundError(path)
    stream = fs.open(p)
    try:
        return bytes(stream.readNBytes(size)), fs.getFileStatus(p).getLen()
    finally:
        stream.close()


def detect_format(first: bytes, path: str) -> str:
    """By the first bytes, then by the suffix; unknown if neither tells."""
    for magic, kind in MAGIC:
        if first.startswith(magic):
            return kind
    if first.lstrip()[:1] in (b"{", b"["):
        return "json"
    low = path.lower()
    return next((kind for suffix, kind in files.FORMATS.items() if low.endswith(suffix)), "unknown")


def encoding_of(first: bytes) -> str:
    """A byte order mark, else ascii or utf-8 if they decode, else latin-1. Bytes of a character that the head cuts off don't count."""
    for bom, name in BOMS:
        if first.startswith(bom):
            return name
    if b"\x00" in first:
        raise UnsupportedEncoding("zero bytes in a text without a byte order mark")
    if first.isascii():
        return "ascii"
    try:
        codecs.getincrementaldecoder("utf-8")().decode(first, final=False)
        return "utf-8"
    except UnicodeDecodeError:
        return "latin-1"


def delimiter_of(text: str, lines: int = 10) -> str | None:
    """Of the first lines: what csv's sniffer finds, else the candidate that stands in most of them; None if none does."""
    some = "\n".join(text.splitlines()[:lines])
    try:
        return csv.Sniffer().sniff(some, DELIMITERS).delimiter
    except csv.Error:
        best = max(DELIMITERS, key=lambda c: (sum(c in x for x in some.splitlines()), some.count(c)))
        return best if best in some else None


def validate(spark: SparkSession, path: str) -> dict:
    """path, size_mb, format, compression, encoding, bom and delimiter; encoding and delimiter are None for binary or packed files."""
    first, size = head(spark, path)
    if not size:
        raise EmptyFile(path)
    kind = detect_format(first, path)
    packed = {"gzip": "gz", "zip": "zip"}.get(kind)
    plain = packed is None and kind in ("csv", "json", "unknown")
    encoding = encoding_of(first) if plain else None
    text = first.decode(encoding, "replace") if encoding else ""
    return {"path": path, "size_mb": round(size / 2**20, 4), "format": kind, "compression": packed, "encoding": encoding, "bom": encoding in {name for _, name in BOMS}, "delimiter": delimiter_of(text) if plain and kind != "json" else None}


def read_validated(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """Reads a file by what its head says; `rows`: the first ones only, where a sample is asked for."""
    seen = validate(spark, path)
    if seen["format"] in ("csv", "unknown") and seen["compression"] is None:
        encoding = {"utf-8-sig": "utf-8", "ascii": "utf-8", "latin-1": "iso-8859-1"}.get(seen["encoding"], seen["encoding"])
        df = spark.read.option("header", True).option("sep", seen["delimiter"] or ",").option("encoding", encoding).csv(path)
    elif seen["format"] == "json":
        df = read_json(spark, path)
    else:
        df = files.read(spark, path)
    return df if rows is None else df.limit(rows)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array, a single object, or an object per line."""
    first, _ = head(spark, path)
    text = first.decode("utf-8", "replace").lstrip("\ufeff \n\r\t")
    lines = text.startswith("{") and sum(x.lstrip().startswith("{") and x.rstrip().endswith("}") for x in text.splitlines()) == len([x for x in text.splitlines() if x.strip()]) and len(text.splitlines()) > 1
    return spark.read.option("multiLine", not lines).json(path)


@dataclass(frozen=True)
class Source:
    """What a URI names: the kind of source, host, port, container (bucket, database), path, user and options."""

    kind: str
    host: str = ""
    port: int | None = None
    container: str = ""
    path: str = ""
    user: str = ""
    options: dict = field(default_factory=dict)

    @property
    def spark_path(self) -> str:
        """The path as Spark's readers take it."""
        scheme = {"s3": "s3a", "gcs": "gs", "adls": "abfss"}.get(self.kind)
        if not scheme:
            return self.path
        where = f"{self.container}@{self.host}" if self.kind == "adls" else self.container
        return f"{scheme}://{where}/{self.path}"


def parse_uri(uri: str) -> Source:
    """URIs of files, stores and databases, and database settings as `key=value` words. Passwords are dropped: they belong to the session's configuration."""
    if "://" not in uri and "=" in uri and all("=" in w for w in uri.split()):
        o = dict(w.split("=", 1) for w in uri.split())
        return Source("postgresql", o.get("host", ""), int(o["port"]) if o.get("port") else None, o.get("dbname", ""), "", o.get("user", ""), {k: v for k, v in o.items() if k not in ("host", "port", "dbname", "user", "password")})
    u = urlsplit(uri)
    if len(u.scheme) == 1:  # a drive's letter
        return Source("file", path=uri)
    if u.scheme not in SCHEMES:
        raise ValueError(f"unknown scheme {u.scheme}")
    kind, options = SCHEMES[u.scheme], dict(parse_qsl(u.query))
    path = unquote(u.path)
    if kind == "file":
        return Source(kind, path=path if u.scheme else uri, options=options)
    if kind == "adls":
        return Source(kind, u.hostname or "", None, u.username or "", path.lstrip("/"), "", options)
    if kind in ("s3", "gcs"):
        return Source(kind, "", None, u.netloc, path.lstrip("/"), "", options)
    database, _, rest = path.lstrip("/").partition("/")
    return Source(kind, u.hostname or "", u.port, database, rest, unquote(u.username or ""), options)


_READERS: dict[str, Callable[..., DataFrame]] = {}


def reader(kind: str):
    """Registers a reader (spark, source, **options) of a kind of source."""

    def register(fn):
        _READERS[kind] = fn
        return fn

    return register


@reader("file")
@reader("s3")
@reader("gcs")
@reader("adls")
def _read_files(spark: SparkSession, source: Source, **options) -> DataFrame:
    return files.read(spark, source.spark_path, **options)


@reader("postgresql")
def _read_database(spark: SparkSession, source: Source, table: str, timeout: int = 120, **options) -> DataFrame:
    url = f"jdbc:postgresql://{source.host or 'localhost'}:{source.port or 5432}/{source.container}"
    return spark.read.format("jdbc").options(url=url, dbtable=table, user=source.user, queryTimeout=str(timeout), **source.options, **options).load()


def open_source(spark: SparkSession, uri: str, **options) -> DataFrame:
    source = parse_uri(uri)
    if source.kind not in _READERS:
        raise ValueError(f"no reader for {source.kind}")
    return _READERS[source.kind](spark, source, **options)


def schema_of(df: DataFrame) -> list[tuple[str, str]]:
    """Names and types, without reading a row."""
    return df.dtypes


def text_sample(df: DataFrame, k: int = 10_000, seed: int = 42) -> DataFrame:
    """k rows by seed, all values as text."""
    from tessella.operators import sampling

    return sampling.exactly(df, k, seed).select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
