"""URLPathHash: a 32-bit FNV-1a hash of a URL's path."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: FNV-1a's offset basis and prime for 32 bits.
OFFSET_BASIS, PRIME = 2166136261, 16777619


def url_path(url: Column) -> Column:
    """What follows the authority up to a query or fragment; empty if there is no slash after it."""
    rest = F.regexp_replace(url, r"(?s)^.*?://", "")
    path = F.regexp_extract(rest, r"(?s)^[^/]*(/.*)$", 1)
    return F.regexp_extract(path, r"(?s)^([^?#]*)", 1)


def url_path_hash(url: Column) -> Column:
    """The hash as a signed 32-bit integer; null for null.

    The bytes are folded by a higher-order function, so no Python runs.
    """
    hexed = F.hex(url_path(url).cast("binary"))
    places = F.when(F.length(hexed) > 0, F.sequence(F.lit(1), F.length(hexed) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    fold = F.aggregate(places, F.lit(OFFSET_BASIS).cast("long"), lambda h, i: (h.bitwiseXOR(F.conv(F.substring(hexed, i, 2), 16, 10).cast("long")) * F.lit(PRIME)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    signed = F.when(fold >= 1 << 31, fold - (1 << 32)).otherwise(fold)
    return F.when(url.isNotNull(), signed).cast("int")


def register(spark: SparkSession) -> None:
    """URLPathHash for SQL, as a SQL function over the same expression."""
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION URLPathHash(url STRING) RETURNS INT RETURN
        CASE WHEN url IS NULL THEN NULL ELSE (SELECT CAST(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS INT) FROM (SELECT aggregate(
            CASE WHEN length(p) > 0 THEN sequence(1, length(p) - 1, 2) ELSE cast(array() AS array<int>) END, CAST({OFFSET_BASIS} AS BIGINT),
            (h, i) -> ((h ^ CAST(conv(substring(p, i, 2), 16, 10) AS BIGINT)) * {PRIME}) & 4294967295) AS h
        FROM (SELECT hex(cast(regexp_extract(regexp_extract(regexp_replace(url, '(?s)^.*?://', ''), '(?s)^[^/]*(/.*)$', 1), '(?s)^([^?#]*)', 1) AS binary)) AS p))) END"""
    )
