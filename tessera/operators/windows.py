"""Ordered operators: shadowing, occurrence numbers, islands, sequence prefixes and edits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..iterate import cut
from .layers import first_winner


def shadowed_members(members: DataFrame, shape: Sequence[str], nearest: str, tie: str) -> DataFrame:
    """Of each member shape the one of the nearest owner."""
    return first_winner(members, shape, nearest, tie)


def occurrences(df: DataFrame, key: Sequence[str], order: Sequence, name: str) -> DataFrame:
    """``slot``: the name for the first of a key, name#n for the n-th."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("__n", n).withColumn("slot", F.when(F.col("__n") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("#"), F.col("__n").cast("string")))).drop("__n")


def islands(df: DataFrame, by: Sequence[str], pos: str) -> DataFrame:
    """Maximal runs of consecutive positions as half-open intervals [first, end); a position that repeats counts once.

    Positions are ranked over all of ``by`` together, by ranges as in ``numbered``: within a run place and rank grow alike,
    so only their difference tells runs apart, and no task sees more than a range, however few values ``by`` has.
    """
    part, rank = "__part", "__rank"
    dealt = df.select(*by, pos).repartitionByRange(*[F.col(c) for c in (*by, pos)]).withColumn(part, F.spark_partition_id())
    ranked = cut(dealt.withColumn(rank, F.dense_rank().over(Window.partitionBy(part).orderBy(*by, pos))))
    starts = _starts(ranked, part, F.max(rank))
    g = F.col(pos) - (F.col("__start") + F.col(rank))
    return ranked.join(F.broadcast(starts), part).select(*by, pos, g.alias("__g")).groupBy(*by, "__g").agg(F.min(pos).alias("first"), (F.max(pos) + 1).alias("end")).drop("__g")


def common_prefix(a: DataFrame, b: DataFrame, by: Sequence[str], pos: str, item: str, reverse: bool = False) -> DataFrame:
    """(by, length): how many leading (or trailing) items of two sequences are equal; positions run from 0 without gaps."""
    def lined(d: DataFrame, v: str) -> DataFrame:
        p = F.col(pos)
        if reverse:
            last = d.groupBy(*by).agg(F.max(pos).alias("__last"))
            d, p = d.join(last, list(by)), F.col("__last") - F.col(pos)
        return d.select(*by, p.alias("__p"), F.col(item).alias(v))

    both = lined(a, "__x").join(lined(b, "__y"), [*by, "__p"], "full")
    odd = F.min(F.when(~F.col("__x").eqNullSafe(F.col("__y")) | F.col("__x").isNull(), F.col("__p")))
    return both.groupBy(*by).agg(F.coalesce(odd, F.max("__p") + 1).cast("long").alias("length"))


def trailing(df: DataFrame, by: str, ts: str, now: Column, hours: int = 1, most: int = 10_000) -> DataFrame:
    """Rows of the last ``hours`` up to ``now``, the latest ``most`` of each key; ties by all columns."""
    recent = df.where((F.col(ts) > now - F.expr(f"INTERVAL {hours} HOURS")) & (F.col(ts) <= now))
    n = F.row_number().over(Window.partitionBy(by).orderBy(F.col(ts).desc(), *[c for c in df.columns if c not in (by, ts)]))
    return recent.withColumn("__n", n).where(F.col("__n") <= most).drop("__n")


def collapse_adjacent(df: DataFrame, by: Sequence[str], order: Sequence, *cols: str) -> DataFrame:
    """Of equal neighbours in order only the first stays."""
    w = Window.partitionBy(*by).orderBy(*order)
    same = F.lit(True)
    for c in cols:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    return df.withColumn("__same", same & (F.row_number().over(w) > 1)).where("not __same").drop("__same")


def presence_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side; a replaced value is no change of presence."""
    a, b = before.select(key).distinct().withColumn("__a", F.lit(1)), after.select(key).distinct().withColumn("__b", F.lit(1))
    return a.join(b, key, "full").where("__a is null or __b is null").select(key, F.when(F.col("__a").isNull(), "appeared").otherwise("vanished").alias("presence"))


def lexical_names(candidates: DataFrame, name: str = "name", depth: str = "scope_depth", kind: str = "kind") -> DataFrame:
    """Innermost candidate per name; a field goes where a local of its name exists."""
    locals_ = candidates.where(F.col(kind) == "local").select(name).distinct()
    fields = candidates.where(F.col(kind) == "field").join(locals_, name, "left_anti")
    return first_winner(candidates.where(F.col(kind) != "field").unionByName(fields), [name], depth, kind)


def sequence_edit(seq: DataFrame, key: str, pos: str, remove: DataFrame | None = None, insert: DataFrame | None = None, replace: DataFrame | None = None) -> DataFrame:
    """A keyed sequence after edits: ``remove`` (key), ``insert`` (key, at) before position ``at``, ``replace`` (key, new).

    Positions are made anew from 0. A move is a removal and an insertion of the same key. Keys must be unique.
    """
    s = seq.select(key, F.col(pos).cast("double").alias("__p"), F.lit(1).alias("__o"))
    if replace is not None:
        s = s.join(replace.select(key, F.col("new").alias("__new")), key, "left").select(F.coalesce("__new", key).alias(key), "__p", "__o")
    if remove is not None:
        s = s.join(remove.select(key), key, "left_anti")
    if insert is not None:
        s = s.unionByName(insert.select(key, F.col("at").cast("double").alias("__p"), F.lit(0).alias("__o")))
    return numbered(s, ["__p", "__o", key], pos).select(key, pos)


def numbered(df: DataFrame, order: Sequence, name: str) -> DataFrame:
    """``df`` with each row's place, from 0, in the order of the whole; no task sees more than a range of it.

    Rows are dealt by ranges and written as sorted parts; the parts' sizes, one number each, give every part its start.
    Rows that are equal in all of ``order`` are in no particular order among themselves.
    """
    part, inner = "__part", "__inner"
    dealt = df.repartitionByRange(*[F.col(c) if isinstance(c, str) else c for c in order])
    kept = cut(dealt.withColumn(part, F.spark_partition_id()))
    starts = _starts(kept, part, F.count("*"))
    rows = kept.withColumn(inner, F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1)
    return rows.join(F.broadcast(starts), part).withColumn(name, F.col("__start") + F.col(inner)).drop(part, inner, "__start")


def _starts(kept: DataFrame, part: str, size: Column) -> DataFrame:
    """(part, __start): the sizes of the parts before each, as one number a part comes to the driver."""
    sizes = {r[part]: r.n for r in kept.groupBy(part).agg(size.alias("n")).collect()}
    start, total = {}, 0
    for k in sorted(sizes):
        start[k], total = total, total + sizes[k]
    return kept.sparkSession.createDataFrame(sorted(start.items()) or [(0, 0)], f"{part} int, __start long")


def require_unique(df: DataFrame, *key: str) -> DataFrame:
    """``df``, or an error while it runs if a key repeats."""
    n = F.count("*").over(Window.partitionBy(*key))
    return df.withColumn("__n", n).where(F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("duplicate key "), F.concat_ws(",", *[F.col(k).cast("string") for k in key]))).cast("boolean")).otherwise(F.lit(True))).drop("__n")
