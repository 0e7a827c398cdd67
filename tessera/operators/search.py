"""Filters, scans, ordering and paging over symbol-like tables; each returns a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col, contains_folded, depth, has_flag, package_of

PRIVATE, STATIC, PUBLIC, PROTECTED = 2, 8, 1, 4


def kind_in(c, kinds: Sequence[str]) -> Column:
    """An empty set of kinds is no filter."""
    return col(c).isin(*kinds) if kinds else F.lit(True)


def exact_identity(query: str, *cols) -> Column:
    out = F.lit(False)
    for c in cols:
        out = out | F.coalesce(col(c) == query, F.lit(False))
    return out


def substring_match(query: str, *cols) -> Column:
    out = F.lit(False)
    for c in cols:
        out = out | F.coalesce(contains_folded(c, query), F.lit(False))
    return out


def within_depth(path, parent: str, levels: int, sep: str = "/") -> Column:
    """Paths under ``parent`` by at most ``levels`` separators."""
    return col(path).startswith(parent + sep) & (depth(path, sep) - parent.count(sep) <= levels)


def visible(kind, has_code, flags) -> Column:
    """Searchable: local, or enriched with code, or not private."""
    return (col(kind) == "local") | col(has_code) | ~has_flag(flags, PRIVATE)


def accessible(flags, owner, viewer_package: str) -> Column:
    return has_flag(flags, PUBLIC | PROTECTED) | (~has_flag(flags, PRIVATE) & (package_of(owner) == viewer_package))


def page(df: DataFrame, order: Sequence, limit: int, after: dict | None = None) -> DataFrame:
    """A keyset page: rows beyond ``after`` (column -> last value, in the order's columns) in order, at most ``limit``.

    A limit of 0 or less is empty. The cursor is a row comparison, so parquet can skip row groups by it.
    """
    if limit <= 0:
        return df.limit(0)
    if after:
        beyond = F.lit(False)
        equal = F.lit(True)
        for c, v in after.items():
            beyond = beyond | (equal & (F.col(c) > F.lit(v)))
            equal = equal & (F.col(c) == F.lit(v))
        df = df.where(beyond)
    return df.orderBy(*order).limit(limit)


def page_with_more(df: DataFrame, order: Sequence[str], limit: int, after: dict | None = None, skip: int = 0) -> DataFrame:
    """A page with ``truncated``: whether one more row was there, seen by asking for limit + 1. ``skip`` rows come before it."""
    got = page(df, order, limit + 1 + skip, after)
    got = got.offset(skip) if skip else got
    w = Window.orderBy(*order)
    return got.withColumn("__rn", F.row_number().over(w)).withColumn("truncated", F.max("__rn").over(Window.partitionBy()) > limit).where(F.col("__rn") <= limit).drop("__rn")


def offset_page(df: DataFrame, order: Sequence, offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(max(0, offset)).limit(max(0, limit))


def point_get(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == F.lit(value)).limit(1)


def prefix_scan(df: DataFrame, key: str, prefix: str) -> DataFrame:
    return df.where(F.col(key).startswith(prefix))


def range_scan(df: DataFrame, key: str, first=None, end=None) -> DataFrame:
    """Half-open range; None is unbounded."""
    if first is not None:
        df = df.where(F.col(key) >= F.lit(first))
    return df if end is None else df.where(F.col(key) < F.lit(end))


def selected_artifacts(artifacts: DataFrame, members: DataFrame | None, workspace=None, with_jdk: bool = False) -> DataFrame:
    """The scan set in precedence order: without a workspace all but sources, else members and, if wanted, the JDK; local first."""
    first = F.when(F.col("kind") == "local", 0).otherwise(1)
    if workspace is None:
        return artifacts.where("kind != 'sources'").withColumn("precedence", F.struct(first.alias("layer"), F.col("artifact_id").alias("pos")))
    own = members.where(F.col("workspace_id") == F.lit(workspace)).groupBy("artifact_id").agg(F.min("pos").alias("pos"))
    got = artifacts.join(own, "artifact_id", "left")
    keep = F.col("pos").isNotNull()
    if with_jdk:
        keep = keep | F.col("path").startswith("jdk:")
    return got.where(keep).withColumn("precedence", F.struct(first.alias("layer"), F.coalesce("pos", F.lit(2**31 - 1).cast(got.schema["pos"].dataType)).alias("pos"))).drop("pos")


def gram_postings(df: DataFrame, key: str, text: str, n: int = 3) -> DataFrame:
    """(gram, key): a derived posting table of lower-cased grams."""
    from ..functions.text import grams

    return df.select(F.explode(grams(F.lower(F.col(text)), n)).alias("gram"), F.col(key))


def gram_search(df: DataFrame, postings: DataFrame, key: str, text: str, query: str, n: int = 3) -> DataFrame:
    """Rows that contain ``query``, through postings: all its grams first, then the text itself. Shorter queries scan."""
    q = query.lower()
    if len(q) < n:
        return df.where(contains_folded(text, query))
    wanted = sorted({q[i : i + n] for i in range(len(q) - n + 1)})
    hit = postings.where(F.col("gram").isin(*wanted)).groupBy(key).agg(F.count_distinct("gram").alias("g")).where(F.col("g") == len(wanted)).select(key)
    return df.join(hit, key, "left_semi").where(contains_folded(text, query))


def overlay_select(facts: DataFrame, postings: dict[str, DataFrame], mode: str, query: str, name: str, key: str, order: Sequence[str], limit: int, after: dict | None = None) -> DataFrame:
    """A page of facts by a query: ``exact``, ``prefix`` or ``substring``; the mode says which posting table is asked.

    ``postings``: by mode, tables of (term, key): whole names, their leading grams, all grams, lower-cased. Grams only name
    candidates, the name decides. A query shorter than a gram scans the names.
    """
    q, n = query.lower(), 3
    if mode == "exact":
        hit = postings["exact"].where(F.col("term") == q).select(key)
    elif len(q) < n:
        hit = facts.select(key)
    elif mode == "prefix":
        hit = postings["prefix"].where(F.col("term") == q[:n]).select(key)
    elif mode == "substring":
        terms = sorted({q[i : i + n] for i in range(len(q) - n + 1)})
        hit = postings["substring"].where(F.col("term").isin(*terms)).groupBy(key).agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(terms)).select(key)
    else:
        raise ValueError(f"no mode: {mode}")
    low = F.lower(name)
    right = {"exact": low == q, "prefix": low.startswith(q), "substring": F.contains(low, F.lit(q))}[mode]
    return page(facts.join(hit.distinct(), key, "left_semi").where(right), order, limit, after)


def name_postings(facts: DataFrame, name: str, key: str) -> dict[str, DataFrame]:
    """The posting tables that ``overlay_select`` asks."""
    low = facts.select(F.lower(name).alias("low"), key)
    return {"exact": low.select(F.col("low").alias("term"), key), "prefix": low.select(F.substring("low", 1, 3).alias("term"), key), "substring": gram_postings(facts, key, name).withColumnRenamed("gram", "term")}


def completion_members(members: DataFrame, package: str, static: bool) -> DataFrame:
    """Members that a completion offers: (id, name, kind, flags, package, depth), ``depth`` that of the declaring type.

    No constructors, packages or modules; a static receiver has static members and types only; private members are left
    out, and those without public or protected access outside their package; a field hides fields of its name further up.
    """
    types = F.col("kind").isin("class", "interface", "enum", "record", "annotation")
    m = members.where(~F.col("kind").isin("ctor", "constructor", "package", "module") & (F.col("flags").bitwiseAND(PRIVATE) == 0))
    m = m.where((F.col("flags").bitwiseAND(5) != 0) | (F.col("package") == package))
    m = m.where(types | (F.col("flags").bitwiseAND(STATIC) != 0)) if static else m
    nearest = m.where("kind = 'field'").groupBy("name").agg(F.min("depth").alias("__nearest"))
    return m.join(nearest, "name", "left").where((F.col("kind") != "field") | (F.col("depth") == F.col("__nearest"))).drop("__nearest")


def layer_trees(facts: DataFrame) -> DataFrame:
    """(tree, key, value) views of one fact table (owner, kind, name, super, annotations, digest).

    T: each type by its name; N: each simple name with the owners that have it; O: each owner with the count and the
    order-free sum of its members' digests; E: each type with what it extends; A: each annotation with its owners.
    """
    types = facts.where("kind = 'type'")
    text = lambda c: F.col(c).cast("string").alias("value")
    t = types.select(F.lit("T").alias("tree"), F.col("owner").alias("key"), text("digest"))
    n = types.select(F.lit("N").alias("tree"), F.col("name").alias("key"), text("owner"))
    own = facts.where("kind != 'type'").groupBy("owner").agg(F.count("*").alias("n"), F.sum(F.col("digest").cast("decimal(38,0)")).alias("s"))
    o = own.select(F.lit("O").alias("tree"), F.col("owner").alias("key"), F.concat_ws(":", F.col("n").cast("string"), F.col("s").cast("string")).alias("value"))
    e = types.where("super is not null").select(F.lit("E").alias("tree"), F.col("owner").alias("key"), text("super"))
    a = types.select(F.lit("A").alias("tree"), F.explode("annotations").alias("key"), text("owner"))
    return t.unionByName(n).unionByName(o).unionByName(e).unionByName(a)
