"""Order-free fingerprints of sets: cardinality and a sum of keyed hashes. They add and subtract, so they merge.

Each member (domain, key, value) has the point of the first 60 bits of a SHA-256. Sums of points are exact decimals, so
partial sums of any partitioning agree; equality means equal sum and equal cardinality. ``limbs`` keeps all 256 bits as
eight sums of 32-bit limbs, and ``identity`` folds these to one residue modulo 2^256.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import canonical


def member(domain: str, *cols) -> Column:
    """The SHA-256 of one member, in hex."""
    return F.sha2(F.concat(F.lit(domain + "|"), canonical(*cols)), 256)


def point(domain: str, *cols) -> Column:
    return F.conv(F.substring(member(domain, *cols), 1, 15), 16, 10).cast("decimal(38,0)")


def fingerprint(domain: str, *cols) -> Column:
    """The aggregate: struct(n, sum)."""
    return F.struct(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(point(domain, *cols)).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).alias("sum"))


def plus(a: Column, b: Column) -> Column:
    return F.struct((a["n"] + b["n"]).alias("n"), (a["sum"] + b["sum"]).cast("decimal(38,0)").alias("sum"))


def minus(a: Column, b: Column) -> Column:
    return F.struct((a["n"] - b["n"]).alias("n"), (a["sum"] - b["sum"]).cast("decimal(38,0)").alias("sum"))


def limbs(h: Column | str) -> list[Column]:
    """Eight aggregates over a column of member digests: the sums of the 32-bit limbs, lowest last."""
    h = F.col(h) if isinstance(h, str) else h
    return [F.sum(F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("bigint")).alias(f"limb{i}") for i in range(8)]


def identity(prefix: str = "limb") -> Column:
    """The sum of members modulo 2^256 in hex, of the eight limb sums; a fold, so that the carry is one expression."""
    word = F.lit(1 << 32).cast("decimal(20,0)")
    sums = F.array(*[F.coalesce(F.col(f"{prefix}{i}"), F.lit(0)).cast("decimal(38,0)") for i in reversed(range(8))])

    def add(s: Column, limb: Column) -> Column:
        v = (limb + s["carry"]).cast("decimal(38,0)")
        low = (v % word).cast("bigint")
        return F.struct(F.concat(F.lpad(F.lower(F.hex(low)), 8, "0"), s["out"]).alias("out"), ((v - low) / word).cast("decimal(38,0)").alias("carry"))

    return F.aggregate(sums, F.struct(F.lit("").alias("out"), F.lit(0).cast("decimal(38,0)").alias("carry")), add)["out"]
