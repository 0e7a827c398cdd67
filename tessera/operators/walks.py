"""Walks that carry state along a hierarchy: inherited documentation, receivers with type arguments, dependency mediation."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import override_eligible, substituted
from ..iterate import cut
from .graph import reach

PLACEHOLDER = "{@inheritDoc}"


def inherited_docs(docs: DataFrame, parents: DataFrame, placeholder: str = PLACEHOLDER) -> DataFrame:
    """(id, doc): the placeholder replaced by the doc of the first parent, by ``pos``, that has one that isn't blank.

    The parent's doc is resolved first, to any depth; without such a parent, or on a cycle, the placeholder becomes empty.
    ``docs``: (id, doc); ``parents``: (id, parent, pos).
    """
    own = docs.select("id", F.coalesce("doc", F.lit("")).alias("doc"))
    asks = F.contains(F.col("doc"), F.lit(placeholder))
    full = own.where(F.trim("doc") != "").select(F.col("id").alias("parent"))
    first = parents.join(full, "parent", "left_semi").groupBy("id").agg(F.min_by("parent", F.struct("pos", "parent")).alias("parent"))
    open_ = cut(own.where(asks).join(first, "id", "left"))
    done = own.where(~asks)
    settled = done
    while True:
        up = settled.select(F.col("id").alias("parent"), F.col("doc").alias("up"))
        now = cut(open_.join(up, "parent").select("id", F.replace("doc", F.lit(placeholder), F.col("up")).alias("doc")))
        if now.isEmpty():
            break
        done, settled = done.unionByName(now), now
        open_ = cut(open_.join(now.select("id"), "id", "left_anti"))
    return done.unionByName(open_.select("id", F.replace("doc", F.lit(placeholder), F.lit("")).alias("doc")))


def receiver_hierarchy(roots: DataFrame, supers: DataFrame, owners: DataFrame) -> DataFrame:
    """(root, owners): each receiver's supertypes in breadth-first order with type arguments in place of variables.

    ``roots``: (root, owner, arguments); ``supers``: (owner, pos, parent, arguments), written in the owner's variables;
    ``owners``: (owner, variables, complete). A receiver that reaches an owner that isn't complete, or is unknown, has null.
    An owner is entered once, by its first way there.
    """
    front = roots.select("root", "owner", "arguments", F.lit(0).alias("level"), F.lit("").alias("way"))
    seen = front
    for level in count(1):
        known = front.join(owners, "owner")
        step = known.join(supers.select("owner", "pos", "parent", F.col("arguments").alias("written")), "owner")
        # a way is the places taken, padded, so that ways sort in breadth-first order
        to = step.select("root", F.col("parent").alias("owner"), F.transform("written", lambda w: substituted(w, "variables", "arguments")).alias("arguments"), F.concat("way", F.lpad(F.col("pos").cast("string"), 6, "0")).alias("way"))
        to = to.groupBy("root", "owner").agg(F.min_by("arguments", "way").alias("arguments"), F.min("way").alias("way")).withColumn("level", F.lit(level))
        front = cut(to.join(seen.select("root", "owner"), ["root", "owner"], "left_anti").select("root", "owner", "arguments", "level", "way"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    shown = F.concat("owner", F.when(F.size("arguments") > 0, F.concat(F.lit("<"), F.array_join("arguments", ","), F.lit(">"))).otherwise(""))
    rows = seen.join(owners.select("owner", "complete"), "owner", "left").withColumn("shown", shown)
    got = rows.groupBy("root").agg(F.bool_and(F.coalesce("complete", F.lit(False))).alias("whole"), F.array_sort(F.collect_list(F.struct("level", "way", "shown"))).alias("all"))
    return got.select("root", F.when(F.col("whole"), F.transform("all", lambda x: x["shown"])).alias("owners"))


def override_parents(methods: DataFrame, supers: DataFrame) -> DataFrame:
    """(id, parent_id, level): the methods that each one overrides, directly or further up, nearest first.

    ``methods``: (id, owner, name, descriptor, flags, package); ``supers``: (child, parent) of owners, any depth.
    """
    e = supers.select(F.col("child").alias("src"), F.col("parent").alias("dst"))
    up = reach(e, methods.select(F.col("owner").alias("id")).distinct(), None)
    c = methods.select("id", F.col("owner").alias("root"), "name", F.col("descriptor").alias("d"), F.col("flags").alias("f"), F.col("package").alias("p"))
    above = methods.select(F.col("id").alias("parent_id"), F.col("owner").alias("up"), F.col("name").alias("up_name"), F.col("descriptor").alias("up_d"), F.col("flags").alias("up_f"), F.col("package").alias("up_p"))
    pairs = c.join(up.select("root", F.col("id").alias("up"), "level"), "root").join(above, ["up"]).where("name = up_name")
    return pairs.where(override_eligible("f", "up_f", "d", "up_d", F.col("p") == F.col("up_p"))).select("id", "parent_id", "level")


def dependency_walk(edges: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, order): mediated dependencies of ``root``, by levels; the nearest version of a name wins, the first of equals.

    ``edges``: (src, dst, version, scope, pos): ``src`` depends on ``dst``. Only winners are entered. nodes: (name, version,
    winner, reason, level); a loser's reason names the version that won. order: (scope, place, name, version), the path of
    winners in each scope.
    """
    spark = edges.sparkSession
    e = cut(edges.select("src", "dst", "version", "scope", "pos"))
    front = spark.createDataFrame([(root, "")], "src string, way string")
    won = spark.createDataFrame([(root, "", 0)], "name string, version string, level int").limit(0)
    winners = losers = None
    for level in count(1):
        seen = e.join(front, "src").select(F.col("dst").alias("name"), "version", "scope", F.concat("way", F.lpad(F.col("pos").cast("string"), 6, "0")).alias("way"))
        seen = cut(seen.where(F.col("name") != root))
        if seen.isEmpty():
            break
        fresh = seen.join(won.select("name"), "name", "left_anti")
        best = cut(fresh.groupBy("name").agg(F.min_by(F.struct("version", "scope", "way"), "way").alias("x")).select("name", "x.*").withColumn("level", F.lit(level)))
        won = won.unionByName(best.select("name", "version", "level"))
        winners = best if winners is None else winners.unionByName(best)
        lost = seen.join(won.select("name", F.col("version").alias("by")), "name").where("version != by")
        lost = lost.select("name", "version", F.lit(False).alias("winner"), F.concat(F.lit("conflict with "), "by").alias("reason"), F.lit(level).alias("level"))
        losers = lost if losers is None else losers.unionByName(lost)
        front = best.select(F.col("name").alias("src"), "way")
    if winners is None:
        none = won.withColumn("scope", F.lit("")).withColumn("place", F.lit(0))
        return won.selectExpr("name", "version", "true as winner", "cast(null as string) as reason", "level"), none.select("scope", "place", "name", "version")
    nodes = winners.select("name", "version", F.lit(True).alias("winner"), F.lit(None).cast("string").alias("reason"), "level").unionByName(losers.distinct())
    order = winners.groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("level", "way", "name", "version"))).alias("all"))
    return nodes, order.select("scope", F.posexplode("all").alias("place", "x")).select("scope", "place", "x.name", "x.version")
