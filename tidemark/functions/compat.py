"""Rewrites of functions that Spark lacks, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def date_bin(width_seconds: int, ts: Column, origin: str = "1970-01-01 00:00:00") -> Column:
    """The start of the bin of width_seconds, counted from origin, that holds ts."""
    micros, start = F.unix_micros(ts.cast("timestamp")), F.unix_micros(F.lit(origin).cast("timestamp"))
    width = F.lit(width_seconds * 1_000_000).cast("long")
    return F.timestamp_micros(micros - F.pmod(micros - start, width))


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two integers, by Euclid's steps in a fold; 0 for two zeros.

    A pair of 64-bit integers takes at most 92 steps.
    """
    pair = F.struct(F.abs(a.cast("long")).alias("x"), F.abs(b.cast("long")).alias("y"))
    step = lambda p, _: F.when(p["y"] == 0, p).otherwise(F.struct(p["y"].alias("x"), F.try_mod(p["x"], p["y"]).alias("y")))
    return F.when(a.isNotNull() & b.isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(92)), pair, step)["x"])


def lcm(a: Column, b: Column) -> Column:
    """Least common multiple of two integers; 0 if one is 0."""
    g = gcd(a, b)
    return F.when(g == 0, F.lit(0).cast("long")).otherwise((F.abs(a.cast("long")) / g).cast("long") * F.abs(b.cast("long")))


#: Names of digests and their bits, as sha2 takes them.
_SHA2 = {"sha224": 224, "sha256": 256, "sha384": 384, "sha512": 512}


def digest(x: Column, algorithm: str) -> Column:
    """The bytes of a digest: md5, sha224, sha256, sha384 or sha512."""
    if algorithm not in ("md5", *_SHA2):
        raise ValueError(f"unknown digest {algorithm!r}")
    return F.unhex(F.md5(x) if algorithm == "md5" else F.sha2(x, _SHA2[algorithm]))


def round_toward_zero(x: Column, digits: int = 0) -> Column:
    """x without its decimals beyond ``digits``."""
    scale = F.lit(10.0**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale) / scale


def groups_frame_rank(partition: list[str], order: list[str]) -> Column:
    """A number for each peer group, over which a RANGE frame is a GROUPS frame."""
    return F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order))
