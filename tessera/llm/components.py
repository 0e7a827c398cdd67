"""Connected components of an edge table by contraction; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): comp is one node of the component; nodes without an edge to another are absent.

    Each round every node points to its smallest neighbour or itself, pointers are followed once more, and the edges are
    rewritten to what their ends point to. Every component with an edge loses at least half of its nodes a round.
    Null ends, loops and repeated edges are ignored. Hubs are pre-aggregated before each shuffle.
    """
    x, y = F.col(a), F.col(b)
    live = edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    live = cut(live.distinct())
    labels, points = None, []
    while not live.isEmpty():
        both = live.select("a", "b").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("to"))
        hop = point.select(F.col("node").alias("to"), F.col("to").alias("then"))
        point = cut(point.join(hop, "to").select("node", F.col("then").alias("to")))
        labels = point.withColumnRenamed("to", "comp") if labels is None else _follow(labels, point)
        old = live
        pa, pb = point.select(F.col("node").alias("a"), F.col("to").alias("ta")), point.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        live = live.join(pa, "a").join(pb, "b").where("ta != tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
        live = cut(live.distinct())
        drop(old)
        points.append(point)
    if labels is None:
        return edges.select(x.alias("node"), x.alias("comp")).limit(0)
    labels = cut(labels)
    drop(*points)
    return labels


def _follow(labels: DataFrame, point: DataFrame) -> DataFrame:
    """Old nodes take the new pointer of their label."""
    p = point.select(F.col("node").alias("comp"), F.col("to"))
    return labels.join(p, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
