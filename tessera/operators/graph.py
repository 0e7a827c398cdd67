"""Graph operators as frontier loops: each level is a join of the frontier with the edges minus what was seen.

Levels are cut by checkpoints, so plans stay small and lost executors don't undo them. Only a flag, whether a level is
empty, comes to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..iterate import cut

#: So many levels are kept as parts of a union before they are written as one table.
PARTS = 16
#: Nodes of a graph whose reachable pairs are made as such; above it cycles are contracted.
SMALL = 2000


def reach(edges: DataFrame, roots: DataFrame, levels: int | None, outgoing: bool = True, kinds: Sequence[str] | None = None, stop: DataFrame | None = None) -> DataFrame:
    """(root, id, level): breadth-first from every root, each node once at its least level, roots not included.

    ``levels`` is the depth of a contract that has one; None walks until no node is new. ``kinds`` restricts edges; an empty list allows none. ``stop``: (id) of nodes that are reached but not expanded.
    """
    e = edges if kinds is None else edges.where(F.col("kind").isin(*kinds)) if kinds else edges.limit(0)
    e = e.select(F.col("src" if outgoing else "dst").alias("id"), F.col("dst" if outgoing else "src").alias("to")).where("id is not null and to is not null").distinct()
    front = roots.select(F.col("id").alias("root"), "id").distinct()
    seen = front.withColumn("level", F.lit(0))
    for level in count(1) if levels is None else range(1, levels + 1):
        live = front if stop is None or level == 1 else front.join(stop.select("id"), "id", "left_anti")
        nxt = live.join(e, "id").select("root", F.col("to").alias("id")).distinct().join(seen.select("root", "id"), ["root", "id"], "left_anti")
        nxt = cut(nxt)
        if nxt.isEmpty():
            break
        seen = seen.unionByName(nxt.withColumn("level", F.lit(level)))
        seen = seen if level % PARTS else cut(seen)
        front = nxt
    return seen.where("level > 0")


def closure(edges: DataFrame, roots: DataFrame, levels: int, kinds: Sequence[str], limit: int | None = None, offset: int = 0, outgoing: bool = True) -> DataFrame:
    """(id, level) over all roots together, ordered by (level, id); an empty list of kinds reaches nothing."""
    got = reach(edges, roots, levels, outgoing, kinds)
    got = got.join(roots.select("id").distinct(), "id", "left_anti").groupBy("id").agg(F.min("level").alias("level")).orderBy("level", "id")
    return got if limit is None else got.offset(offset).limit(max(0, limit))


def closure_pairs(edges: DataFrame, a: str, b: str, levels: int | None = None) -> DataFrame:
    """(a, b, level) of all pairs that a path joins, or one of at most ``levels`` edges."""
    e = edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).distinct()
    got = reach(e, e.select(F.col("src").alias("id")), levels)
    return got.select(F.col("root").alias(a), F.col("id").alias(b), "level")


def descendants(edges: DataFrame, roots: DataFrame, levels: int | None = None) -> DataFrame:
    return reach(edges, roots, levels).select("id").distinct()


def reverse_closure(depends: DataFrame, roots: DataFrame, covered: DataFrame | None = None, levels: int | None = None) -> DataFrame:
    """(id): the roots and all that depend on them in any number of steps; covered nodes that are no roots are not entered."""
    e = depends.select("src", "dst")
    if covered is not None:
        shut = covered.select("id").join(roots.select("id"), "id", "left_anti").withColumnRenamed("id", "src")
        e = e.join(shut, "src", "left_anti")
    return reach(e, roots, levels, outgoing=False).select("id").unionByName(roots.select("id")).distinct()


def cycles(edges: DataFrame) -> DataFrame:
    """(id): nodes on a cycle; a node with an edge to itself is on one."""
    label = strong_labels(edges)
    large = label.groupBy("comp").agg(F.count("*").alias("n")).where("n > 1").select("comp")
    loops = edges.where("src = dst").select(F.col("src").alias("id"))
    return label.join(large, "comp", "left_semi").select("id").unionByName(loops).distinct()


def _core(edges: DataFrame) -> DataFrame:
    """Edges without those of nodes that have no way in or no way out, again and again: what is left can be on cycles."""
    left, size = edges, edges.count()
    while size:
        kept = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        left, before = cut(kept.select("src", "dst")), size
        size = left.count()
        if size == before:
            break
    return left


def _closed(e: DataFrame) -> DataFrame:
    """All (src, dst) joined by a path, by doubling."""
    pairs = cut(e.distinct())
    size = pairs.count()
    while True:
        more = pairs.alias("p").join(pairs.alias("q"), F.col("p.dst") == F.col("q.src")).select(F.col("p.src").alias("src"), F.col("q.dst").alias("dst"))
        pairs = cut(pairs.unionByName(more).distinct())
        now = pairs.count()
        if now == size:
            return pairs
        size = now


def strong_labels(edges: DataFrame) -> DataFrame:
    """(id, comp) of the nodes that can be on cycles: their strong component's least node.

    Each turn every node of the trimmed graph follows one of its edges, another in each turn. As all have one, these ways
    end in cycles; pointer doubling finds their nodes and least names in logarithmically many joins over one row a node.
    Each cycle is one node from then on, and edges are rewritten, until no edge is left. Space is linear in the edges. What
    has SMALL nodes or fewer, at first or by then, is closed over pairs at once, which takes fewer steps.
    """
    e = cut(edges.select("src", "dst").where("src is not null and dst is not null and src != dst").distinct())
    label = None
    for turn in count():
        e = _core(e)
        if e.isEmpty():
            break
        if label is None:
            label = cut(e.select(F.col("src").alias("id")).distinct().withColumn("comp", F.col("id")))
        if e.select("src").distinct().count() <= SMALL:
            r = _closed(e)
            both = r.join(r.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"])
            least = both.groupBy(F.col("src").alias("comp")).agg(F.min("dst").alias("least"))
            return cut(label.join(least, "comp", "left").select("id", F.least("comp", F.coalesce("least", "comp")).alias("comp")))
        step = cut(e.groupBy("src").agg(F.min_by("dst", F.struct(F.xxhash64("dst", F.lit(turn)), "dst")).alias("to")).select(F.col("src").alias("v"), "to", F.least("src", "to").alias("least")))
        for _ in range(max(1, step.count().bit_length())):
            on = step.select(F.col("v").alias("to"), F.col("to").alias("then"), F.col("least").alias("more"))
            step = cut(step.join(on, "to").select("v", F.col("then").alias("to"), F.least("least", "more").alias("least")))
        ring = cut(step.join(step.select(F.col("to").alias("v")).distinct(), "v", "left_semi").select("v", "least"))
        name = lambda c, other: e.join(ring.select(F.col("v").alias(c), F.col("least").alias("__n")), c, "left").select(F.coalesce("__n", c).alias(c), other)
        e = cut(name("src", "dst"))
        e = cut(name("dst", "src").where("src != dst").select("src", "dst").distinct())
        label = cut(label.join(ring.select(F.col("v").alias("comp"), "least"), "comp", "left").select("id", F.coalesce("least", "comp").alias("comp")))
    if label is None:
        return edges.select(F.col("src").alias("id"), F.col("src").alias("comp")).limit(0)
    return label


def components(edges: DataFrame, nodes: DataFrame, unknown: DataFrame | None = None) -> DataFrame:
    """(id, comp, final): strongly connected components, named by their least node.

    A component is final only if nothing that it reaches is unknown.
    """
    ids = nodes.select("id").distinct()
    out = ids.join(strong_labels(edges), "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))
    if unknown is None:
        return out.withColumn("final", F.lit(True))
    bad = reverse_closure(edges.select("src", "dst").distinct(), unknown.select("id")).withColumn("__bad", F.lit(True))
    bad = out.join(bad, "id").select("comp").distinct().withColumn("__bad", F.lit(True))
    return out.join(bad, "comp", "left").select("id", "comp", F.col("__bad").isNull().alias("final"))


def topological_levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, level): dependencies first (src depends on dst); nodes on or behind a cycle have level null."""
    left = cut(nodes.select("id").distinct())
    e = cut(edges.select("src", "dst").distinct().where("src != dst").unionByName(edges.where("src = dst").select("src", "dst").distinct()))
    out = None
    for level in count():
        ready = cut(left.join(e.select(F.col("src").alias("id")), "id", "left_anti"))
        if ready.isEmpty():
            break
        now = ready.withColumn("level", F.lit(level))
        out = now if out is None else out.unionByName(now)
        out = out if (level + 1) % PARTS else cut(out)
        left = cut(left.join(ready, "id", "left_anti"))
        e = cut(e.join(ready.withColumnRenamed("id", "dst"), "dst", "left_anti"))
    rest = left.withColumn("level", F.lit(None).cast("int"))
    return rest if out is None else out.unionByName(rest)


def heights(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, height): 1 + the greatest height of what a node consumes; null on or behind a cycle."""
    return topological_levels(edges, nodes).select("id", (F.col("level") + 1).alias("height"))


def folded_identities(edges: DataFrame, nodes: DataFrame, own: str = "own") -> DataFrame:
    """(id, identity): digest of a node's own value and its parents' identities in order; empty on or behind a cycle.

    Level by level over the topological order; src's parents are its dst.
    """
    order = cut(topological_levels(edges, nodes))
    top = order.agg(F.max("level")).first()[0]
    e = edges.select("src", "dst").distinct()
    done = None
    for level in range(0 if top is None else top + 1):
        now = order.where(F.col("level") == level).select("id").join(nodes.select("id", own), "id")
        if done is None:
            got = now.select("id", F.sha2(F.concat(F.col(own), F.lit("|")), 256).alias("identity"))
        else:
            up = e.join(done.select(F.col("id").alias("dst"), "identity"), "dst").groupBy(F.col("src").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("identity")), ",").alias("ups"))
            got = now.join(up, "id", "left").select("id", F.sha2(F.concat(F.col(own), F.lit("|"), F.coalesce("ups", F.lit(""))), 256).alias("identity"))
        got = cut(got)
        done = got if done is None else done.unionByName(got)
    rest = order.where("level is null").select("id", F.lit("").alias("identity"))
    return rest if done is None else done.unionByName(rest)


def propagate(edges: DataFrame, states: DataFrame, changed: DataFrame, recompute) -> tuple[DataFrame, DataFrame]:
    """Height-ordered propagation with early cut-off: (states after, ids whose result changed).

    ``states``: (id, height, result); ``edges``: src consumes dst; ``recompute(ids, states, edges)`` gives (id, result).
    Lowest heights first; where the result is the same as before, consumers are not entered.
    """
    dirty = cut(changed.select("id").distinct())
    now = states
    moved = None
    for h in count(1):
        at = now.where(F.col("height") == h).select("id")
        turn = cut(dirty.join(at, "id", "left_semi"))
        if not turn.isEmpty():
            new = recompute(turn, now, edges)
            diff = cut(new.join(now.select("id", F.col("result").alias("__old")), "id").where(~F.col("result").eqNullSafe(F.col("__old"))).select("id", "result"))
            now = cut(now.join(diff.withColumnRenamed("result", "__new"), "id", "left").select("id", "height", F.coalesce("__new", "result").alias("result")))
            moved = diff.select("id") if moved is None else moved.unionByName(diff.select("id"))
            more = edges.join(diff.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))
            dirty = cut(dirty.unionByName(more).distinct())
        if now.where(F.col("height") > h).join(dirty, "id", "left_semi").isEmpty():
            break
    return now, moved if moved is not None else changed.select("id").limit(0)
