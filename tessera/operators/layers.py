"""Layered precedence: first winner per identity, masking by complete owners, ordered search with exact negatives."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_winner(df: DataFrame, identity: Sequence[str], *order: Column | str) -> DataFrame:
    """One row per identity, the first in ``order``.

    An aggregate, not a window: map-side partial results keep one row per identity and task, so a hot identity needs no
    task that holds all its rows. ``order`` should end in a unique column.
    """
    ranked = F.struct(*order)
    rest = [c for c in df.columns if c not in identity]
    best = df.groupBy(*identity).agg(F.min_by(F.struct(*rest), ranked).alias("__w"))
    return best.select(*identity, *[F.col(f"__w.{c}").alias(c) for c in rest]).select(*df.columns)


def layered_union(layers: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """First layer that has a key wins; the result names its ``layer_rank``."""
    every = reduce(lambda a, b: a.unionByName(b), [d.withColumn("layer_rank", F.lit(i)) for i, d in enumerate(layers)])
    return first_winner(every, key, "layer_rank")


def masked_union(layers: Sequence[DataFrame], owner: str, key: str, completeness: Sequence[DataFrame]) -> DataFrame:
    """Members by layer precedence where a COMPLETE owner of an upper layer hides that owner's members below.

    ``completeness[i]`` is (owner, status) of layer i, with status COMPLETE, PARTIAL or UNKNOWN. PARTIAL merges with what
    is below; UNKNOWN hides what is below and marks the owner's rows as UNKNOWN.
    """
    kept = []
    for i, members in enumerate(layers):
        own = members
        for upper in completeness[:i]:
            own = own.join(upper.where("status in ('COMPLETE', 'UNKNOWN')").select(owner).distinct(), owner, "left_anti")
        kept.append(own)
    merged = layered_union(kept, [owner, key])
    unknown = reduce(lambda a, b: a.unionByName(b), [c.where("status = 'UNKNOWN'").select(owner) for c in completeness]).distinct().withColumn("__u", F.lit(True))
    return merged.join(unknown, owner, "left").withColumn("status", F.when(F.col("__u"), "UNKNOWN").otherwise("FOUND")).drop("__u")


def ordered_search(queries: DataFrame, entries: DataFrame, declares: DataFrame, name: str = "name", entry: str = "artifact_id") -> DataFrame:
    """The first entry in order that declares each name.

    ``entries``: (artifact_id, pos, indexed); ``declares``: (name, artifact_id). Result: name, status FOUND, ABSENT or
    UNKNOWN, winner, searched (entries looked at). An unindexed entry before the winner makes the answer UNKNOWN.
    """
    bounds = entries.agg(F.count("*").alias("entries"), F.min(F.when(~F.col("indexed"), F.col("pos"))).alias("gap"))
    hit = declares.join(entries, entry).where("indexed").groupBy(name).agg(F.min_by(entry, "pos").alias("winner"), F.min("pos").alias("pos"))
    out = queries.select(name).distinct().join(hit, name, "left").crossJoin(F.broadcast(bounds))
    blocked = F.col("gap").isNotNull() & (F.col("pos").isNull() | (F.col("gap") < F.col("pos")))
    status = F.when(blocked, "UNKNOWN").when(F.col("pos").isNotNull(), "FOUND").otherwise("ABSENT")
    return out.select(name, status.alias("status"), F.when(~blocked, F.col("winner")).alias("winner"), F.when(F.col("pos").isNotNull() & ~blocked, F.col("pos") + 1).otherwise(F.col("entries")).cast("long").alias("searched"))


def bind(wanted: DataFrame, key: str, *providers: DataFrame) -> DataFrame:
    """(key, value, provider): the first provider, in order, that has the key; keys without one go."""
    out = wanted
    for i, p in enumerate(providers):
        out = out.join(p.select(key, F.col("value").alias(f"__v{i}")), key, "left")
    value = F.coalesce(*[F.col(f"__v{i}") for i in range(len(providers))])
    which = F.coalesce(*[F.when(F.col(f"__v{i}").isNotNull(), F.lit(i)) for i in range(len(providers))])
    return out.select(*wanted.columns, value.alias("value"), which.alias("provider")).where("value is not null")


def unbuilt(wanted: DataFrame, key: str, siblings: DataFrame, *providers: DataFrame) -> DataFrame:
    """(key, error): wanted keys that are siblings of the same build and that no provider has; they are faults, not gaps."""
    own = wanted.join(siblings.select(key).distinct(), key, "left_semi")
    for p in providers:
        own = own.join(p.where("value is not null").select(key), key, "left_anti")
    return own.select(key, F.concat(F.lit("not built: "), F.col(key).cast("string")).alias("error"))


def replace_file(base: DataFrame, new: DataFrame, file_col: str, files: DataFrame | None = None) -> DataFrame:
    """All rows of the files in ``new`` (or ``files``, so that a file can become empty) are replaced."""
    gone = (files if files is not None else new).select(file_col).distinct()
    return base.join(gone, file_col, "left_anti").unionByName(new)


def apply_edits(base: DataFrame, removed: DataFrame, added: DataFrame, key: Sequence[str]) -> DataFrame:
    """(base - removed) + added; an added key beats both."""
    gone = removed.select(*key).unionByName(added.select(*key)).distinct()
    return base.join(gone, list(key), "left_anti").unionByName(added)
