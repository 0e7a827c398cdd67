"""Set and sequence algebra."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def difference(a: DataFrame, b: DataFrame, *key: str) -> DataFrame:
    return a.select(*key).distinct().join(b.select(*key), list(key), "left_anti")


def candidates(*posts: DataFrame) -> DataFrame:
    out = posts[0]
    for p in posts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def canonical_set(df: DataFrame, by: Sequence[str], item: str) -> DataFrame:
    """(by, items sorted and distinct, identity)."""
    got = df.groupBy(*by).agg(F.array_sort(F.collect_set(item)).alias("items"))
    return got.withColumn("identity", F.sha2(F.array_join(F.transform("items", lambda x: x.cast("string")), "|"), 256))


def myers(a: list, b: list) -> list[tuple[str, int, int]]:
    """Shortest edit script of two lists: (keep | remove | add, position in a, position in b); -1 where there is none."""
    n, m = len(a), len(b)
    ends, trace = {1: 0}, []
    for d in range(n + m + 1):
        trace.append(dict(ends))
        for k in range(-d, d + 1, 2):
            x = ends[k + 1] if k == -d or (k != d and ends[k - 1] < ends[k + 1]) else ends[k - 1] + 1
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            ends[k] = x
            if x >= n and x - k >= m:
                return _walk(trace, n, m, d)
    return []


def _walk(trace: list[dict], x: int, y: int, d: int) -> list[tuple[str, int, int]]:
    out = []
    for step in range(d, -1, -1):
        ends, k = trace[step], x - y
        px, py = 0, 0
        if step:
            pk = k + 1 if k == -step or (k != step and ends[k - 1] < ends[k + 1]) else k - 1
            px, py = ends[pk], ends[pk] - pk
        while x > px and y > py and (x, y) != (0, 0) and x - 1 >= px and y - 1 >= py:
            x, y = x - 1, y - 1
            out.append(("keep", x, y))
        if step:
            if x == px:
                out.append(("add", -1, y - 1))
            else:
                out.append(("remove", x - 1, -1))
            x, y = px, py
    return out[::-1]


def ordered_diff(a: DataFrame, b: DataFrame, by: str, pos: str, item: str) -> DataFrame:
    """(by, change, item, from_pos, to_pos) of two sequences per group: removed and added items; a move is both.

    Myers' algorithm has no relational form; one pair of sequences is one unit of work in ``cogroup``.
    """
    kind = dict(a.dtypes)[by]

    def run(key, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        # a side without rows has no columns either
        left, right = ([] if side.empty else side.sort_values(p)[i].tolist() for side, p, i in ((x, pos, item), (y, f"__{pos}", f"__{item}")))
        rows = [(key[0], c, left[i] if c == "remove" else right[j], i, j) for c, i, j in myers(left, right) if c != "keep"]
        return pd.DataFrame(rows, columns=[by, "change", item, "from_pos", "to_pos"])

    # names of their own for the right side: where both come from one table, Spark prunes it by the left side's columns
    right = b.select(*[F.col(c).alias(f"__{c}") for c in (by, pos, item)])
    return a.select(by, pos, item).groupBy(by).cogroup(right.groupBy(f"__{by}")).applyInPandas(run, f"{by} {kind}, change string, {item} string, from_pos long, to_pos long")
