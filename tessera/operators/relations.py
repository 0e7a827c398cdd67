"""Joins over symbols, edges and artifacts. Theta joins are made equi-joins by exploding prefixes or buckets."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import dotted_prefixes
from ..iterate import cut
from .layers import first_winner


def resolve_targets(edges: DataFrame, symbols: DataFrame, target: str = "target_key", key: str = "binary_key", precedence: Sequence = ("pos",)) -> DataFrame:
    """Edges with the first symbol, in artifact precedence, that has the target's key; the others are dropped."""
    return edges.join(first_winner(symbols, [key], *precedence), edges[target] == symbols[key])


def resolve_inherited(edges: DataFrame, members: DataFrame, parents: DataFrame, levels: int | None = None) -> DataFrame:
    """(owner, name) resolved in the owner or else the nearest supertype that has a member of the name.

    Walks until every name is found or has no supertype left, or ``levels`` steps if given; cycles end, as no owner is
    entered twice for a name.

    ``edges``: (src, owner, name); ``members``: (owner, name, id, flags); ``parents``: (child, parent). Private members
    are not inherited. Result: src, owner, name, found_in, id, levels. The frontier shrinks as names are found.
    """
    open_ = edges.select("src", "owner", "name").distinct().withColumn("at", F.col("owner"))
    visited = open_
    done = None
    for level in count() if levels is None else range(levels + 1):
        m = members.select(F.col("owner").alias("at"), "name", "id", "flags")
        if level:
            m = m.where(F.col("flags").bitwiseAND(2) == 0)
        hit = open_.join(m, ["at", "name"]).groupBy("src", "owner", "name").agg(F.min_by("at", F.struct("at", "id")).alias("found_in"), F.min_by("id", F.struct("at", "id")).alias("id")).withColumn("levels", F.lit(level))
        hit = cut(hit)
        done = hit if done is None else done.unionByName(hit)
        rest = open_.join(hit.select("src", "owner", "name"), ["src", "owner", "name"], "left_anti")
        step = rest.join(parents, rest["at"] == parents["child"]).select("src", "owner", "name", F.col("parent").alias("at")).distinct()
        open_ = cut(step.join(visited, ["src", "owner", "name", "at"], "left_anti"))
        visited = visited.unionByName(open_)
        visited = visited if (level + 1) % 16 else cut(visited)
        if open_.isEmpty():
            break
    return done


def members_of(symbols: DataFrame, owners: DataFrame, prefix: str = "", owner: str = "owner_id") -> DataFrame:
    found = symbols.join(owners.select(owner).distinct(), owner, "left_semi")
    return found.where(F.col("name").startswith(prefix)) if prefix else found


def unique_match(left: DataFrame, right: DataFrame, on: Sequence[str], left_id: str, right_id: str) -> tuple[DataFrame, DataFrame]:
    """(matched, unmatched): left rows with exactly one match; the rest, with how many there were."""
    pairs = left.join(right.select(*on, right_id), list(on), "left")
    counted = pairs.groupBy(left_id).agg(F.count(right_id).alias("matches"), F.min(right_id).alias(right_id))
    return counted.where("matches = 1").select(left_id, right_id), counted.where("matches != 1").select(left_id, "matches")


def relationships(edges: DataFrame, symbols: DataFrame, roots: DataFrame, kinds: Sequence[str], outgoing: bool = True) -> DataFrame:
    """Edges of the roots with both endpoints present; one row per (src, dst, kind), ordered by these."""
    at = "src" if outgoing else "dst"
    own = edges.where(F.col("kind").isin(*kinds)).join(roots.select(F.col("id").alias(at)).distinct(), at, "left_semi")
    ids = symbols.select("id")
    own = own.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return own.select("src", "dst", "kind").distinct().orderBy("src", "dst", "kind")


def referencing(refs: DataFrame, targets: DataFrame, artifact: str, target: str) -> DataFrame:
    """Artifacts whose reference set holds any of the targets."""
    return refs.join(targets.select(target), target, "left_semi").select(artifact).distinct()


def unresolved(targets: DataFrame, known: DataFrame, target: str, key: str) -> DataFrame:
    return targets.join(known.select(F.col(key).alias(target)), target, "left_anti")


def overrides(methods: DataFrame, extends: DataFrame, transitive: bool = True) -> DataFrame:
    """(child_id, parent_id): same name and parameters in a supertype; neither private nor static, parent accessible.

    ``methods``: (id, owner, name, params, flags, package); ``extends``: (child, parent) of owners. A pair can only come
    twice by an id that has several rows, so only pairs of such ids are made distinct; the others, which may be as many as
    the square of the methods of one shape, go from the join straight to the result.
    """
    from .graph import closure_pairs

    up = closure_pairs(extends, "child", "parent", None if transitive else 1).select("child", "parent")
    able = methods.where(F.col("flags").bitwiseAND(10) == 0).select("id", "owner", "name", "params", "flags", "package")

    def pairs(of: DataFrame, over: DataFrame) -> DataFrame:
        child = of.select(F.col("id").alias("child_id"), F.col("owner").alias("child"), "name", "params", F.col("package").alias("child_package"))
        parent = over.select(F.col("id").alias("parent_id"), F.col("owner").alias("parent"), "name", "params", F.col("package").alias("parent_package"), F.col("flags").alias("parent_flags"))
        got = child.join(up, "child").join(parent, ["parent", "name", "params"])
        return got.where((F.col("parent_flags").bitwiseAND(5) != 0) | (F.col("child_package") == F.col("parent_package"))).select("child_id", "parent_id")

    many = cut(able.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("__id")))
    if many.isEmpty():
        return pairs(able, able)
    same = F.col("id").eqNullSafe(F.col("__id"))
    once, more = able.join(many, same, "left_anti"), able.join(many, same, "left_semi").distinct()
    return pairs(once, once).unionByName(pairs(more, able).unionByName(pairs(once, more)).distinct())


def keyed_diff(before: DataFrame, after: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """key, change: added, removed or changed; null values are equal to each other."""
    a, b = before.select(*key, F.col(value).alias("__a"), F.lit(1).alias("__x")), after.select(*key, F.col(value).alias("__b"), F.lit(1).alias("__y"))
    change = F.when(F.col("__x").isNull(), "added").when(F.col("__y").isNull(), "removed").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    return a.join(b, list(key), "full").select(*key, change.alias("change")).where("change is not null")


def prefix_waiters(waiting: DataFrame, names: DataFrame, waiter: str, unresolved_name: str, name: str) -> DataFrame:
    """Waiters whose unresolved name is ``*``, equals a name, or is a dotted prefix of one or has one as prefix."""
    w = waiting.select(waiter, F.col(unresolved_name).alias("__u"))
    n = names.select(F.col(name).alias("__n")).distinct()
    star = w.where("__u = '*'").select(waiter)
    below = w.join(n.select(F.explode(dotted_prefixes("__n")).alias("__u")).distinct(), "__u", "left_semi").select(waiter)
    above = w.select(waiter, F.explode(dotted_prefixes("__u")).alias("__n")).join(n, "__n", "left_semi").select(waiter)
    return star.unionByName(below).unionByName(above).distinct()


def longest_prefix(rows: DataFrame, roots: DataFrame, path: str, root: str, sep: str = "/") -> DataFrame:
    """Each row with the longest root that is its path or an ancestor directory of it; rows without one have null.

    Ancestors are exploded, so it is an equi-join; the root table may have any size. A path is looked up once, however
    often it comes.
    """
    parts = F.split(F.col(path), sep)
    steps = rows.select(path).distinct().select(path, F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), sep))).alias("__len", root))
    best = steps.join(roots.select(root).distinct(), root).groupBy(path).agg(F.max_by(root, "__len").alias(root))
    return rows.join(best, path, "left").select(*rows.columns, root)


def innermost_interval(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, span_id: str, bucket: int, on: Sequence[str] = ()) -> DataFrame:
    """Each point with the smallest span that holds it (start <= at < end; ties by id); points without one are dropped.

    Buckets come in sizes ``bucket``, twice that, four times that and so on. A span is cut by the first size that isn't
    shorter than it, so into two buckets at most, however long it is; a place is looked up once in each size.
    """
    size = F.greatest(F.lit(0), F.ceil(F.log2((F.col(end) - F.col(start)) / bucket))).cast("int")
    width = lambda level: F.lit(bucket).cast("long") * F.call_function("shiftleft", F.lit(1).cast("long"), level)
    in_bucket = lambda x, level: F.floor(x / width(level)).cast("long")
    s = spans.where(F.col(end) > F.col(start)).withColumn("__size", size)
    top = s.agg(F.max("__size")).first()[0] or 0
    s = s.withColumn("__b", F.explode(F.sequence(in_bucket(F.col(start), F.col("__size")), in_bucket(F.col(end) - 1, F.col("__size")))))
    places = points.select(at, *on).distinct().withColumn("__size", F.explode(F.sequence(F.lit(0), F.lit(top)))).withColumn("__b", in_bucket(F.col(at), F.col("__size")))
    hit = places.join(s, ["__size", "__b", *on]).where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end)))
    order = F.struct((F.col(end) - F.col(start)), span_id)
    best = hit.groupBy(at, *on).agg(F.min_by(span_id, order).alias(span_id))
    return points.join(best, [at, *on]).select(*points.columns, span_id)


def fallback_match(left: DataFrame, right: DataFrame, exact: Sequence[str], coarse: Sequence[str], value: str, order: str) -> DataFrame:
    """Exact match, else the first by the coarse key, with ``warned``."""
    fine = right.select(*exact, F.col(value).alias("__e"))
    wide = right.groupBy(*coarse).agg(F.min_by(value, order).alias("__c"))
    got = left.join(fine, list(exact), "left").join(wide, list(coarse), "left")
    return got.select(*left.columns, F.coalesce("__e", "__c").alias(value), (F.col("__e").isNull() & F.col("__c").isNotNull()).alias("warned"))


def ordered_fallback(left: DataFrame, key: str, *maps: tuple[str, DataFrame]) -> DataFrame:
    """(key, definer, route): the first of the named (key, definer) tables that has the key."""
    out = left
    for name, m in maps:
        out = out.join(m.select(key, F.col("definer").alias(f"__{name}")), key, "left")
    return out.select(*left.columns, F.coalesce(*[F.col(f"__{n}") for n, _ in maps]).alias("definer"), F.coalesce(*[F.when(F.col(f"__{n}").isNotNull(), F.lit(n)) for n, _ in maps]).alias("route"))


def when_position(c, order: Sequence[str]) -> Column:
    """Rank of a value in a given order; others come last."""
    out = F.lit(len(order))
    for i, v in reversed(list(enumerate(order))):
        out = F.when(F.col(c) == v, i).otherwise(out)
    return out
