"""Partition transforms: values as column expressions, and their directory names."""

from __future__ import annotations

import datetime
import re
import urllib.parse
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPOCH = datetime.date(1970, 1, 1)


@dataclass(frozen=True)
class Transform:
    kind: str  # identity, year, month, day, hour, bucket, truncate, void
    column: str
    width: int = 0

    @property
    def name(self) -> str:
        return {"identity": self.column, "bucket": f"{self.column}_bucket_{self.width}", "truncate": f"{self.column}_trunc_{self.width}"}.get(self.kind, f"{self.column}_{self.kind}")


def parse(text: str) -> Transform:
    """col, kind(col), bucket(n, col) or truncate(w, col)."""
    m = re.fullmatch(r"""\s*(?:(\w+)\s*\(\s*(?:(\d+)\s*,\s*)?)?([`"]?)([\w.]+)\3(?:\s*,\s*(\d+))?\s*(\))?\s*""", text)
    kind = (m[1] or "identity").lower().rstrip("s") if m else ""
    kind = {"date": "day"}.get(kind, kind)
    width = int(m[2] or m[5] or 0) if m else 0
    if not m or bool(m[1]) != bool(m[6]) or kind not in ("identity", "year", "month", "day", "hour", "bucket", "truncate", "void") or (kind in ("bucket", "truncate")) != (width > 0):
        raise ValueError(f"unsupported partition expression: {text.strip()}")
    return Transform(kind, m[4], width)


def _murmur3(data: bytes) -> int:
    """32-bit murmur3 with seed 0 (a public algorithm; its constants are fixed values)."""
    c1, c2, mask = 0xCC9E2D51, 0x1B873593, 0xFFFFFFFF
    h = 0
    tail = len(data) & ~3
    words = [int.from_bytes(data[i : i + 4], "little") for i in range(0, tail, 4)]
    last = int.from_bytes(data[tail:], "little")
    for k in words:
        k = k * c1 & mask
        k = (k << 15 | k >> 17) & mask
        h ^= k * c2 & mask
        h = (h << 13 | h >> 19) & mask
        h = (h * 5 + 0xE6546B64) & mask
    if last:
        k = last * c1 & mask
        k = (k << 15 | k >> 17) & mask
        h ^= k * c2 & mask
    h ^= len(data)
    for shift, times in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> shift) * times & mask
    return h


def bucket_of(value, n: int) -> int | None:
    """The bucket of an integer, date, timestamp (in microseconds), string or bytes."""
    if value is None or value is pd.NaT or value != value:
        return None
    if isinstance(value, str):
        data = value.encode()
    elif isinstance(value, (bytes, bytearray)):
        data = bytes(value)
    elif isinstance(value, datetime.date) and not isinstance(value, datetime.datetime):
        data = (value - EPOCH).days.to_bytes(8, "little", signed=True)
    else:
        data = int(value).to_bytes(8, "little", signed=True)
    return (_murmur3(data) & 0x7FFFFFFF) % n


def value_of(t: Transform, kind: T.DataType) -> Column:
    """The transform's value for each row; null for null."""
    c = F.col(f"`{t.column}`")
    when = lambda x: F.when(c.isNotNull(), x)
    if t.kind == "identity":
        return c
    if t.kind == "void":
        return F.lit(None).cast("string")
    if t.kind == "year":
        return when(F.year(c) - 1970)
    if t.kind == "month":
        return when((F.year(c) - 1970) * 12 + F.month(c) - 1)
    if t.kind == "day":
        return when(F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")))
    if t.kind == "hour":
        return when(F.floor(F.unix_micros(c.cast("timestamp")) / 3_600_000_000).cast("int"))
    if t.kind == "truncate":
        if isinstance(kind, (T.StringType,)):
            return F.substring(c, 1, t.width)
        if isinstance(kind, T.BinaryType):
            return F.substring(c, 1, t.width)
        step = F.lit(t.width) if not isinstance(kind, T.DecimalType) else F.lit(t.width).cast(T.DecimalType(38, 0)) * F.lit(f"1e-{kind.scale}").cast(T.DecimalType(kind.scale + 1, kind.scale))
        return (c - F.pmod(c, step)).cast(kind)
    width = t.width
    source = F.unix_micros(c.cast("timestamp")) if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else c

    @F.pandas_udf("int")
    def bucket(s: pd.Series) -> pd.Series:
        return s.map(lambda v: bucket_of(v, width)).astype("Int32")

    return bucket(source)


def human(t: Transform, value) -> str:
    """The value as its directory name shows it."""
    if value is None:
        return "null"
    if t.kind == "year":
        return f"{1970 + value:04d}"
    if t.kind == "month":
        return f"{1970 + value // 12:04d}-{value % 12 + 1:02d}"
    if t.kind == "day":
        return (EPOCH + datetime.timedelta(days=value)).isoformat()
    if t.kind == "hour":
        return (datetime.datetime(1970, 1, 1) + datetime.timedelta(hours=value)).strftime("%Y-%m-%d-%H")
    if isinstance(value, bool):
        return str(value).lower()
    return value.isoformat() if isinstance(value, (datetime.date, datetime.datetime)) else str(value)


def directory(transforms: list[Transform], values: list) -> str:
    """name=value/... with both encoded as in a URL's query."""
    return "/".join(f"{urllib.parse.quote_plus(t.name, safe='*-._')}={urllib.parse.quote_plus(human(t, v), safe='*-._')}" for t, v in zip(transforms, values))
