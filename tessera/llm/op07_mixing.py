"""Mixing sources to target weights, in DataFrame functions alone.

Every document gets a hash-random key (60 bits of an md5 of seed and doc_id). Keys are uniform, so equal cuts of the key
space are the ranges of a range sort without a sampling pass: ``RANGES`` of them in each source. Word counts are summed
per (source, range), prefix sums over a source's ranges give each range its start, and a window inside a range gives each
document its place. A source's budget is then cut exactly: whole epochs first, then documents in key order, the last one
in part. No task gets a source: the largest unit is one range of one source. The weights go round by the order of the
sources, so targets are worked out over one row a source in one task: some millions of sources at most. Targets are
broadcast up to ``BROADCAST_ROWS`` sources and joined by a shuffle beyond.

Defined results: null text has size 0; null source is a source of its own, last in order; rows with equal keys are in
order of doc_id and size (rows equal in both are interchangeable); an empty table gives an empty table; when all sizes
are 0 all targets are 0. Repeated rows are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut

#: Ranges of the key space in each source; 1e10 rows of one source are 2.4 million in a range.
RANGES = 4096
WEIGHTS, SEED = (3, 1, 2), "mix-1"


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), cap: int = 2) -> DataFrame:
    """(g, source_size, target) of (g, source_size): water filling in closed form over one row a source.

    A source's fill is its weight times one level, at most ``cap`` times its size. With sources in order of the level at
    which they are full, the level is that of the first source that the rest of the budget doesn't fill. Sums are whole
    numbers, so reruns agree to the last bit.
    """
    p, q = share
    by_name = Window.orderBy("g")
    s = sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
    full = (F.lit(cap) * F.col("source_size")).alias("full")
    order = Window.orderBy((F.col("full") / F.col("w")), "g")
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.select("*", full).select(
        "*",
        F.coalesce(F.sum("full").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("w_rest"),
        F.sum("source_size").over(every).alias("whole"),
    )
    # the level is (p * whole - q * before) / (q * w_rest)
    num, den = F.lit(p) * F.col("whole") - F.lit(q) * F.col("before"), F.lit(q) * F.col("w_rest")
    holds = F.col("w") * num <= F.col("full") * den
    s = s.select("*", F.when(holds, F.struct(F.col("full") / F.col("w"), "g", num.alias("num"), den.alias("den"))).alias("level"))
    s = s.select("*", F.min("level").over(every).alias("at"))
    fill = F.col("w") * F.col("at.num")
    exact = F.when(fill >= F.col("full") * F.col("at.den"), F.col("full").cast("double")).otherwise(fill.cast("double") / F.col("at.den").cast("double"))
    return s.select("g", "source_size", F.coalesce(exact, F.col("full").cast("double")).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), cap: int = 2, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): one row per row of ``docs``; ``cap`` epochs at most."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    key = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key"))
    rows = rows.select("*", F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), "source")).alias("g"), F.shiftright("key", 48).alias("r"))
    rows = cut(rows)
    ranges = cut(rows.groupBy("g", "r").agg(F.sum("size").alias("range_size")))
    goal = cut(targets(ranges.groupBy("g").agg(F.sum("range_size").alias("source_size")), weights, share, cap))
    few = F.broadcast if goal.count() <= BROADCAST_ROWS else (lambda df: df)
    goal = goal.withColumn("budget", F.floor("target").cast("long"))
    positive = F.greatest(F.col("source_size"), F.lit(1))
    goal = goal.withColumn("epochs", F.floor(F.col("budget") / positive).cast("long")).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    before = F.sum("range_size").over(Window.partitionBy("g").orderBy("r").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("range_size")
    starts = ranges.select("g", "r", before.alias("start")).join(few(goal), "g")
    place = F.sum("size").over(Window.partitionBy("g", "r").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = rows.join(starts, ["g", "r"]).select("*", (F.col("start") + place - F.col("size")).alias("at"))
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("at")))
    return placed.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


SQL = r"""
WITH rows_ AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key,
    CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS g
  FROM documents),
s1 AS (SELECT g, sum(size)::BIGINT AS source_size FROM rows_ GROUP BY g),
s2 AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY g) - 1) % 3 + 1)::INT] AS w, 2 * source_size AS filled FROM s1),
s3 AS (SELECT *, coalesce(sum(filled) OVER (ORDER BY filled::DOUBLE / w, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(w) OVER (ORDER BY filled::DOUBLE / w, g ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_rest, sum(source_size) OVER () AS whole FROM s2),
lv AS (SELECT arg_min(3 * whole - 2 * before, (filled::DOUBLE / w, g)) AS num, arg_min(2 * w_rest, (filled::DOUBLE / w, g)) AS den
  FROM s3 WHERE w * (3 * whole - 2 * before) <= filled * (2 * w_rest)),
s4 AS (SELECT g, source_size, CASE WHEN w * num >= filled * den THEN filled::DOUBLE ELSE (w * num)::DOUBLE / den::DOUBLE END AS target FROM s3, lv),
s5 AS (SELECT *, floor(target)::BIGINT AS budget FROM s4),
s6 AS (SELECT *, budget // greatest(source_size, 1) AS epochs FROM s5),
placed AS (SELECT r.*, s.source_size, s.target, s.epochs, s.budget - s.epochs * s.source_size AS rest,
  sum(r.size) OVER (PARTITION BY r.g ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - r.size AS spot
  FROM rows_ r JOIN s6 s USING (g))
SELECT doc_id, source, size, source_size, target, (epochs * size + least(size, greatest(0, rest - spot)))::BIGINT AS taken FROM placed
"""
