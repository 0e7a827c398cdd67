"""Group reports, discrete and interpolated quantiles, digests and rollups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fingerprint import fingerprint
from ..functions.text import canonical, col, path_prefixes


def conflict_report(df: DataFrame, key: str, owner: str, label: str, least: int = 2) -> DataFrame:
    """Keys with at least ``least`` distinct owners, and their labels joined by "; " in order."""
    one = df.select(key, owner, label).distinct()
    return one.groupBy(key).agg(F.count_distinct(owner).alias("owners"), F.array_join(F.array_sort(F.collect_set(label)), "; ").alias("labels")).where(F.col("owners") >= least)


def definer_counts(df: DataFrame, key: str, definer: str, pos: str) -> DataFrame:
    """(key, n, first): how many distinct definers a key has and the first by position; no list of them is made."""
    return df.groupBy(key).agg(F.count_distinct(definer).alias("n"), F.min_by(definer, F.struct(pos, definer)).alias("first"))


def bounded_count(df: DataFrame, most: int) -> DataFrame:
    """n: rows, counted until there are more than ``most``."""
    return df.limit(most + 1).agg(F.count("*").alias("n"))


def discrete_percentiles(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """count, p50 = sorted[(n - 1) / 2] and p95 = sorted[ceil(0.95 n) - 1], without interpolation."""
    return df.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})").alias("p50"),
        F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"),
    )


def refcounts(paths: DataFrame, key: str) -> DataFrame:
    return paths.groupBy(key).agg(F.count("*").alias("refs"))


def merkle_buckets(df: DataFrame, domain: str, *cols, bits: int = 8) -> DataFrame:
    """(bucket, n, sum): order-free fingerprints by the leading bits of the key's digest; the first column is the key."""
    bucket = F.floor(F.conv(F.substring(F.sha2(canonical(cols[0]), 256), 1, 4), 16, 10).cast("int") / (1 << (16 - bits))).cast("int")
    got = df.groupBy(bucket.alias("bucket")).agg(fingerprint(domain, *cols).alias("fp"))
    return got.select("bucket", F.col("fp.n").alias("n"), F.col("fp.sum").alias("sum"))


def merkle_root(buckets: DataFrame) -> DataFrame:
    """root: digest of the buckets in order; there are at most 2^bits of them."""
    line = F.concat_ws(":", F.col("bucket").cast("string"), F.col("n").cast("string"), F.col("sum").cast("string"))
    return buckets.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", line.alias("line")))), lambda x: x["line"]), ","), 256).alias("root"))


def sorted_digest(by: Sequence[str], df: DataFrame, *cols) -> DataFrame:
    """identity: digest of a group's distinct members in order. For groups that fit an executor; else use fingerprints."""
    return df.groupBy(*by).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(canonical(*cols))), ","), 256).alias("identity"))


def definers(df: DataFrame, key: str, definer: str, order: str) -> DataFrame:
    """(key, n, first, definers in route order)."""
    ranked = F.array_sort(F.collect_set(F.struct(order, definer)))
    got = df.groupBy(key).agg(ranked.alias("__r"))
    return got.select(key, F.size("__r").alias("n"), F.col("__r")[0][definer].alias("first"), F.transform("__r", lambda x: x[definer]).alias("definers"))


def chain_rollup(df: DataFrame, path: str, *aggregates: Column, sep: str = "/") -> DataFrame:
    """Every ancestor directory with aggregates over the files below it; directories without files don't come."""
    return df.withColumn("directory", F.explode(path_prefixes(path, sep))).groupBy("directory").agg(*aggregates)


def fresh(classes: DataFrame, sources: DataFrame, by: str, mtime: str = "mtime") -> DataFrame:
    """(by, fresh): the oldest class is no older than the newest source; without classes it is stale."""
    c = classes.groupBy(by).agg(F.min(mtime).alias("__c"))
    s = sources.groupBy(by).agg(F.max(mtime).alias("__s"))
    return s.join(c, by, "left").select(by, F.coalesce(F.col("__c") >= F.col("__s"), F.lit(False)).alias("fresh"))


def upsert_counters(base: DataFrame, delta: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    return base.select(name, value).unionByName(delta.select(name, value)).groupBy(name).agg(F.sum(value).cast("long").alias(value))


def ambiguity(df: DataFrame, *cols: str) -> DataFrame:
    """Rows with how many share their columns, and whether more than one does; by a join on pre-aggregated counts."""
    counts = df.groupBy(*[F.col(c).alias(f"__{c}") for c in cols]).agg(F.count("*").alias("same"))
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return df.join(counts, cond).select(*df.columns, "same", (col("same") > 1).alias("ambiguous"))
