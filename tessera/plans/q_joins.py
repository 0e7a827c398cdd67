"""Joins, layers, diffs and set algebra over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layers as ly
from ..operators import relations as rel
from ..operators import sets
from ..operators import windows as win
from .registry import query


@query("J01_target_resolution", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, w.id FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'Brand#' || (l_partkey % 25) AS target FROM lineitem) l JOIN (SELECT p_brand, min(p_partkey) AS id FROM part GROUP BY p_brand) w ON w.p_brand = l.target")
def _(t):
    edges = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat(F.lit("Brand#"), F.col("l_partkey") % 25).alias("target_key"))
    sym = t.part.select(F.col("p_brand").alias("binary_key"), F.col("p_partkey").alias("id"), F.col("p_partkey").alias("pos"))
    return rel.resolve_targets(edges, sym).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "id")


@query("J01b_edge_link", "SELECT p_partkey AS src, s_suppkey AS dst FROM part JOIN supplier ON s_suppkey = p_partkey % 97")
def _(t):
    return t.part.select(F.col("p_partkey").alias("src"), (F.col("p_partkey") % 97).alias("s_suppkey")).join(t.supplier, "s_suppkey").select("src", F.col("s_suppkey").alias("dst"))


@query("J02_owner_members", "SELECT p_brand, p_partkey, p_name FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size = 50) AND starts_with(p_name, 'b')")
def _(t):
    p = t.part.select("p_brand", "p_partkey", F.col("p_name").alias("name"))
    return rel.members_of(p, t.part.where("p_size = 50"), "b", "p_brand").select("p_brand", "p_partkey", F.col("name").alias("p_name"))


_J03 = "SELECT l.doc_id, count(b.item_id) AS m, min(b.item_id) AS item_id FROM (SELECT doc_id, n_chars % 300 AS k FROM documents) l LEFT JOIN (SELECT item_id, length(text) % 300 AS k FROM benchmark) b USING (k) GROUP BY l.doc_id"


@query("J03_declaration_join", f"SELECT doc_id, item_id FROM ({_J03}) WHERE m = 1")
def _(t):
    return _declared(t)[0]


@query("J03b_unmatched", f"SELECT doc_id, m::BIGINT AS matches FROM ({_J03}) WHERE m <> 1")
def _(t):
    return _declared(t)[1]


def _declared(t):
    left = t.documents.select("doc_id", (F.col("n_chars") % 300).cast("long").alias("k"))
    right = t.benchmark.select("item_id", (F.length("text") % 300).cast("long").alias("k"))
    return rel.unique_match(left, right, ["k"], "doc_id", "item_id")


@query("J04_documentation_join", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(t):
    return t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")


@query("J05_edge_endpoints", "SELECT DISTINCT l_suppkey AS src, l_partkey AS dst, l_returnflag AS kind FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3) AND l_partkey IN (SELECT p_partkey FROM part UNION SELECT s_suppkey FROM supplier)")
def _(t):
    edges = t.lineitem.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("kind"))
    sym = t.supplier.select(F.col("s_suppkey").alias("id")).unionByName(t.part.select(F.col("p_partkey").alias("id"))).distinct()
    return rel.relationships(edges, sym, t.supplier.where("s_nationkey = 3").select(F.col("s_suppkey").alias("id")), ["A", "R"])


@query("J06_referencing_artifacts", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_name = 'blue bolt')")
def _(t):
    return rel.referencing(t.lineitem.select("l_orderkey", "l_partkey"), t.part.where("p_name = 'blue bolt'").select(F.col("p_partkey").alias("l_partkey")), "l_orderkey", "l_partkey")


@query("J06b_owning_artifacts", "SELECT DISTINCT l_suppkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type = 'PROMO'")
def _(t):
    return t.lineitem.join(t.part.where("p_type = 'PROMO'"), F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey").distinct()


@query("J07_unresolved_targets", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY')")
def _(t):
    return rel.unresolved(t.orders.select("o_orderkey", "o_custkey"), t.customer.where("c_mktsegment <> 'MACHINERY'"), "o_custkey", "c_custkey")


@query(
    "J08_first_winner_search",
    """WITH e AS (SELECT s_suppkey AS artifact_id, row_number() OVER (ORDER BY s_suppkey) - 1 AS pos, s_suppkey <> 40 AS indexed FROM supplier),
d AS (SELECT DISTINCT 'P' || (l_partkey % 3000) AS name, l_suppkey AS artifact_id FROM lineitem WHERE l_quantity > 40),
q AS (SELECT 'P' || p_partkey AS name FROM part),
h AS (SELECT name, min(pos) AS pos, arg_min(artifact_id, pos) AS winner FROM d JOIN e USING (artifact_id) WHERE indexed GROUP BY name),
g AS (SELECT min(pos) FILTER (NOT indexed) AS gap, count(*) AS entries FROM e)
SELECT name, CASE WHEN gap IS NOT NULL AND (pos IS NULL OR gap < pos) THEN 'UNKNOWN' WHEN pos IS NOT NULL THEN 'FOUND' ELSE 'ABSENT' END AS status,
CASE WHEN NOT (gap IS NOT NULL AND (pos IS NULL OR gap < pos)) THEN winner END AS winner,
CASE WHEN pos IS NOT NULL AND NOT (gap IS NOT NULL AND gap < pos) THEN pos + 1 ELSE entries END::BIGINT AS searched FROM q LEFT JOIN h USING (name), g""",
)
def _(t):
    from pyspark.sql import Window

    e = t.supplier.select(F.col("s_suppkey").alias("artifact_id"), (F.row_number().over(Window.orderBy("s_suppkey")) - 1).cast("long").alias("pos"), (F.col("s_suppkey") != 40).alias("indexed"))
    d = t.lineitem.where("l_quantity > 40").select(F.concat(F.lit("P"), F.col("l_partkey") % 3000).alias("name"), F.col("l_suppkey").alias("artifact_id")).distinct()
    return ly.ordered_search(t.part.select(F.concat(F.lit("P"), "p_partkey").alias("name")), e, d)


@query(
    "J09_override_join",
    """WITH RECURSIVE e AS (SELECT DISTINCT 'B' || i AS child, 'B' || (i // 2) AS parent FROM range(1, 26) r(i)),
up AS (SELECT child, parent FROM e UNION SELECT up.child, e.parent FROM up JOIN e ON e.child = up.parent),
m AS (SELECT p_partkey AS id, 'B' || replace(p_brand, 'Brand#', '') AS owner, p_name AS name, p_type AS params, p_size AS flags, p_type AS package FROM part WHERE (p_size & 10) = 0)
SELECT DISTINCT c.id AS child_id, p.id AS parent_id FROM m c JOIN up ON up.child = c.owner JOIN m p ON p.owner = up.parent AND p.name = c.name AND p.params = c.params WHERE ((p.flags & 5) <> 0 OR p.package = c.package)""",
)
def _(t):
    ext = t.spark.range(1, 26).select(F.concat(F.lit("B"), "id").alias("child"), F.concat(F.lit("B"), F.floor(F.col("id") / 2)).alias("parent"))
    m = t.part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("B"), F.replace("p_brand", F.lit("Brand#"), F.lit(""))).alias("owner"), F.col("p_name").alias("name"), F.col("p_type").alias("params"), F.col("p_size").alias("flags"), F.col("p_type").alias("package"))
    return rel.overrides(m, ext)


@query("J10_layer_precedence", "SELECT source, doc_id, CASE WHEN doc_id % 5 = 0 THEN 0 WHEN source IN ('src1', 'src2') THEN NULL WHEN doc_id % 2 = 0 THEN 1 WHEN source = 'src3' THEN NULL ELSE 2 END AS layer_rank, CASE WHEN source = 'src2' THEN 'UNKNOWN' ELSE 'FOUND' END AS status FROM documents WHERE CASE WHEN doc_id % 5 = 0 THEN 0 WHEN source IN ('src1', 'src2') THEN NULL WHEN doc_id % 2 = 0 THEN 1 WHEN source = 'src3' THEN NULL ELSE 2 END IS NOT NULL")
def _(t):
    d = t.documents.select("source", "doc_id")
    up = d.select("source").distinct()
    live = up.select("source", F.when(F.col("source") == "src1", "COMPLETE").when(F.col("source") == "src2", "UNKNOWN").otherwise("PARTIAL").alias("status"))
    local = up.select("source", F.when(F.col("source") == "src3", "COMPLETE").otherwise("PARTIAL").alias("status"))
    return ly.masked_union([d.where("doc_id % 5 = 0"), d.where("doc_id % 2 = 0"), d], "source", "doc_id", [live, local])


_SNAP_A = "SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderdate < DATE '1999-01-01'"
_SNAP_B = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderdate >= DATE '1997-01-01'"


def _snapshots(t):
    a = t.orders.where("o_orderdate < DATE '1999-01-01'").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    b = t.orders.where("o_orderdate >= DATE '1997-01-01'").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 10 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("v"))
    return a, b


@query("J11_keyed_diff", f"SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM ({_SNAP_A}) a FULL JOIN ({_SNAP_B}) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v IS DISTINCT FROM b.v")
def _(t):
    return rel.keyed_diff(*_snapshots(t), ["k"], "v")


@query("J12_coordinate_binding", "SELECT * FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'session' WHEN s_suppkey % 2 = 0 THEN 'built' WHEN s_suppkey % 5 = 0 THEN 'default' END AS value, CASE WHEN s_suppkey % 3 = 0 THEN 0 WHEN s_suppkey % 2 = 0 THEN 1 WHEN s_suppkey % 5 = 0 THEN 2 END AS provider FROM supplier) WHERE value IS NOT NULL")
def _(t):
    own = t.supplier.select("s_suppkey")
    layer = lambda m, v: own.where(F.col("s_suppkey") % m == 0).withColumn("value", F.lit(v))
    return ly.bind(own, "s_suppkey", layer(3, "session"), layer(2, "built"), layer(5, "default"))


@query(
    "J13_dotted_prefix_join",
    "WITH w AS (SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN '*' WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_brand || '.' || p_type || '.' || p_size END AS u FROM part), n AS (SELECT DISTINCT p_brand || '.' || p_type AS n FROM part WHERE p_brand IN ('Brand#3', 'Brand#7')) SELECT DISTINCT p_partkey FROM w LEFT JOIN n ON u = n OR starts_with(n, u || '.') OR starts_with(u, n || '.') WHERE n IS NOT NULL OR u = '*'",
)
def _(t):
    u = F.when(F.col("p_partkey") % 50 == 0, "*").when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.concat_ws(".", "p_brand", "p_type", "p_size"))
    names = t.part.where("p_brand in ('Brand#3', 'Brand#7')").select(F.concat_ws(".", "p_brand", "p_type").alias("n"))
    return rel.prefix_waiters(t.part.select("p_partkey", u.alias("u")), names, "p_partkey", "u", "n")


@query("J14_reverse_dependencies", "SELECT DISTINCT o_custkey FROM orders JOIN (SELECT l_orderkey FROM lineitem WHERE l_partkey IN (5, 6, 7)) ON l_orderkey = o_orderkey")
def _(t):
    changed = t.lineitem.where("l_partkey in (5, 6, 7)").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.join(changed, "o_orderkey", "left_semi").select("o_custkey").distinct()


@query("J15_code_reference_step", "SELECT DISTINCT l_suppkey, l_partkey, l_returnflag FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO') AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND l_returnflag IN ('A', 'N') ORDER BY l_suppkey, l_partkey, l_returnflag")
def _(t):
    able = t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    front = t.part.where("p_type = 'PROMO'").select(F.col("p_partkey").alias("l_partkey"))
    got = t.lineitem.where("l_returnflag in ('A', 'N')").select("l_suppkey", "l_partkey", "l_returnflag")
    return got.join(front, "l_partkey", "left_semi").join(able, "l_suppkey", "left_semi").distinct().orderBy("l_suppkey", "l_partkey", "l_returnflag")


@query("J16_hierarchy_join", "SELECT n_nationkey AS src, n_regionkey AS dst, 'extends' AS kind FROM nation WHERE n_nationkey % 7 <> 0")
def _(t):
    edges = t.nation.where("n_nationkey % 7 <> 0").select(F.col("n_nationkey").cast("int").alias("src"), F.col("n_regionkey").alias("dst"), F.lit("extends").alias("kind"))
    ids = t.nation.select(F.col("n_nationkey").alias("id")).unionByName(t.region.select(F.col("r_regionkey").alias("id"))).distinct()
    return rel.relationships(edges, ids, ids, ["extends", "implements", "overrides"])


@query("J17_two_key_lookup", "SELECT a.s_suppkey AS src, b.s_suppkey AS dst FROM supplier a, supplier b WHERE a.s_name = 'Supplier#000000003' AND b.s_nationkey = 5")
def _(t):
    a = t.supplier.where("s_name = 'Supplier#000000003'").select(F.col("s_suppkey").alias("src"), F.lit(1).alias("one"))
    b = t.supplier.where("s_nationkey = 5").select(F.col("s_suppkey").alias("dst"), F.lit(1).alias("one"))
    return b.join(F.broadcast(a), "one").select("src", "dst")


@query("J18_longest_prefix", "SELECT page_id, CASE WHEN contains(url, '/en/1') AND split_part(url, '/', 5) = '1' THEN 'x' WHEN split_part(url, '/', 4) = 'en' THEN 'http:' || '//' || split_part(url, '/', 3) || '/en' ELSE 'http://' || split_part(url, '/', 3) END AS root FROM pages WHERE starts_with(url, 'http://')")
def _(t):
    pages = t.pages.where(F.col("url").startswith("http://")).select("page_id", "url")
    p = F.split("url", "/")
    roots = pages.select(F.array_join(F.slice(p, 1, 3), "/").alias("root")).unionByName(pages.where(p[3] == "en").select(F.array_join(F.slice(p, 1, 4), "/").alias("root"))).distinct()
    return rel.longest_prefix(pages, roots, "url", "root").select("page_id", "root")


@query(
    "J19_point_in_interval",
    "WITH s AS (SELECT p_partkey AS id, p_partkey * 3 AS a, p_partkey * 3 + p_size + 1 AS b FROM part), p AS (SELECT o_orderkey AS k, o_orderkey % 6000 AS x FROM orders) SELECT k, x, arg_min(id, (b - a, id)) AS id FROM p JOIN s ON a <= x AND x < b GROUP BY k, x",
)
def _(t):
    spans = t.part.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 3).alias("a"), (F.col("p_partkey") * 3 + F.col("p_size") + 1).alias("b"))
    points = t.orders.select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 6000).alias("x"))
    return rel.innermost_interval(points, spans, "x", "a", "b", "id", 64)


@query("J20_variant_choice", "SELECT l_orderkey, l_linenumber, l_partkey, v.s_suppkey FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) l JOIN (SELECT l_partkey, min(l_suppkey) AS s_suppkey FROM lineitem GROUP BY l_partkey) v USING (l_partkey)")
def _(t):
    variant = ly.first_winner(t.lineitem.select("l_partkey", F.col("l_suppkey").alias("s_suppkey")), ["l_partkey"], "s_suppkey")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").distinct().join(variant, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "s_suppkey")


@query("J21_route_definer", "SELECT p_partkey, CASE WHEN p_size < 10 THEN p_brand WHEN p_type = 'PROMO' THEN 'conflict' WHEN p_partkey % 2 = 0 THEN 'sibling' END AS definer, CASE WHEN p_size < 10 THEN 'own' WHEN p_type = 'PROMO' THEN 'conflict' WHEN p_partkey % 2 = 0 THEN 'sibling' END AS route FROM part")
def _(t):
    own = t.part.where("p_size < 10").select("p_partkey", F.col("p_brand").alias("definer"))
    conflict = t.part.where("p_type = 'PROMO'").select("p_partkey", F.lit("conflict").alias("definer"))
    sibling = t.part.where("p_partkey % 2 = 0").select("p_partkey", F.lit("sibling").alias("definer"))
    return rel.ordered_fallback(t.part.select("p_partkey"), "p_partkey", ("own", own), ("conflict", conflict), ("sibling", sibling))


@query("J22_coordinate_fallback", "WITH m AS (SELECT p_brand, p_type, min(p_partkey) AS id FROM part WHERE p_size > 25 GROUP BY ALL), c AS (SELECT p_brand, arg_min(id, p_type) AS id FROM m GROUP BY p_brand) SELECT p.p_partkey, p.p_brand, p.p_type, coalesce(m.id, c.id) AS id, m.id IS NULL AND c.id IS NOT NULL AS warned FROM part p LEFT JOIN m USING (p_brand, p_type) LEFT JOIN c ON c.p_brand = p.p_brand")
def _(t):
    m = t.part.where("p_size > 25").groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("id"))
    return rel.fallback_match(t.part.select("p_partkey", "p_brand", "p_type"), m, ["p_brand", "p_type"], ["p_brand"], "id", "p_type")


@query("W01_variant_preference", "SELECT l_partkey, l_suppkey, l_quantity FROM (SELECT l_partkey, l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_partkey ORDER BY CASE l_linestatus WHEN 'O' THEN 0 ELSE 1 END, l_suppkey, l_quantity) AS rn FROM lineitem) WHERE rn = 1")
def _(t):
    d = t.lineitem.select("l_partkey", "l_suppkey", "l_quantity", F.when(F.col("l_linestatus") == "O", 0).otherwise(1).alias("layer"))
    return ly.first_winner(d, ["l_partkey"], "layer", "l_suppkey", "l_quantity").select("l_partkey", "l_suppkey", "l_quantity")


@query("W03_member_shadowing", "SELECT p_name, p_type, arg_min(p_partkey, (p_size, p_partkey)) AS id FROM part GROUP BY p_name, p_type")
def _(t):
    return win.shadowed_members(t.part.select("p_name", "p_type", F.col("p_partkey").alias("id"), "p_size"), ["p_name", "p_type"], "p_size", "id").select("p_name", "p_type", "id")


@query("W04_occurrence_numbering", "SELECT p_partkey, p_name || CASE WHEN n = 1 THEN '' ELSE '#' || n END AS slot FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)")
def _(t):
    return win.occurrences(t.part.select("p_partkey", "p_name"), ["p_name"], [F.col("p_partkey").asc_nulls_last()], "p_name").select("p_partkey", "slot")


@query("W05_gaps_and_islands", "SELECT o_orderstatus, min(o_orderkey) AS first, max(o_orderkey) + 1 AS \"end\" FROM (SELECT o_orderstatus, o_orderkey, o_orderkey - row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS g FROM orders) GROUP BY o_orderstatus, g")
def _(t):
    return win.islands(t.orders.select("o_orderstatus", "o_orderkey"), ["o_orderstatus"], "o_orderkey")


_SEQ = "SELECT conv_id, turn, role FROM conversations"


def _sequences(t, edit):
    a = t.conversations.select("conv_id", "turn", "role")
    return a, a.withColumn("role", F.when(edit, "tool").otherwise(F.col("role")))


@query("W06_common_prefix", f"WITH b AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 5 = 3 THEN 'tool' ELSE role END AS role FROM conversations) SELECT conv_id, coalesce(min(turn) FILTER (a.role <> b.role), max(turn) + 1)::BIGINT AS length FROM ({_SEQ}) a JOIN b USING (conv_id, turn) GROUP BY conv_id")
def _(t):
    a, b = _sequences(t, (F.col("conv_id") + F.col("turn")) % 5 == 3)
    return win.common_prefix(a, b, ["conv_id"], "turn", "role")


@query("W06b_common_suffix", f"WITH b AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 5 = 3 THEN 'tool' ELSE role END AS role FROM conversations), m AS (SELECT conv_id, max(turn) AS top FROM conversations GROUP BY conv_id) SELECT conv_id, coalesce(min(top - turn) FILTER (a.role <> b.role), max(top) + 1)::BIGINT AS length FROM ({_SEQ}) a JOIN b USING (conv_id, turn) JOIN m USING (conv_id) GROUP BY conv_id")
def _(t):
    a, b = _sequences(t, (F.col("conv_id") + F.col("turn")) % 5 == 3)
    return win.common_prefix(a, b, ["conv_id"], "turn", "role", reverse=True)


@query("W07_trailing_hour", "SELECT event_id, user_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events WHERE ts > TIMESTAMP '2024-01-15 11:00:00' AND ts <= TIMESTAMP '2024-01-15 12:00:00') WHERE n <= 10000")
def _(t):
    now = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    return win.trailing(t.events.select("event_id", "user_id", "ts"), "user_id", "ts", now)


@query("W08_collapse_adjacent", "SELECT user_id, ts, event_type FROM (SELECT user_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type")
def _(t):
    return win.collapse_adjacent(t.events.select("event_id", "user_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "ts", "event_type")


@query("W09_presence_change", f"SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'appeared' ELSE 'vanished' END AS presence FROM ({_SNAP_A}) a FULL JOIN ({_SNAP_B}) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def _(t):
    return win.presence_changes(*_snapshots(t), "k")


@query("W10_lexical_shadowing", "WITH c AS (SELECT p_name AS name, p_size AS d, CASE WHEN p_type = 'PROMO' AND p_size < 5 THEN 'local' WHEN p_type = 'SMALL' THEN 'field' ELSE 'type' END AS kind FROM part), f AS (SELECT * FROM c WHERE kind <> 'field' OR name NOT IN (SELECT name FROM c WHERE kind = 'local')) SELECT name, min(d) AS d, arg_min(kind, (d, kind)) AS kind FROM f GROUP BY name")
def _(t):
    kind = F.when((F.col("p_type") == "PROMO") & (F.col("p_size") < 5), "local").when(F.col("p_type") == "SMALL", "field").otherwise("type")
    return win.lexical_names(t.part.select(F.col("p_name").alias("name"), F.col("p_size").alias("d"), kind.alias("kind")), "name", "d", "kind")


@query("U01_layer_union", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 1 END AS layer_rank FROM documents")
def _(t):
    d = t.documents.select("doc_id")
    return ly.layered_union([d.where("doc_id % 4 = 0"), d], ["doc_id"])


@query("U02_candidate_union", "SELECT p_partkey FROM part WHERE p_size < 5 UNION SELECT p_partkey FROM part WHERE p_type = 'PROMO'")
def _(t):
    return sets.candidates(t.part.where("p_size < 5").select("p_partkey"), t.part.where("p_type = 'PROMO'").select("p_partkey"))


@query("U03_difference", f"SELECT k FROM ({_SNAP_A}) EXCEPT SELECT k FROM ({_SNAP_B})")
def _(t):
    a, b = _snapshots(t)
    return sets.difference(a, b, "k")


@query("U04_distinct", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def _(t):
    return t.lineitem.select("l_suppkey", "l_returnflag").distinct()


@query("U05_intersection_test", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(t):
    return t.orders.join(t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey")


@query("U06_apply_edits", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 0 THEN 'added' ELSE 'base' END AS v FROM orders WHERE o_orderkey % 10 = 0 OR o_orderkey % 5 <> 0")
def _(t):
    base = t.orders.select(F.col("o_orderkey").alias("k"), F.lit("base").alias("v"))
    return ly.apply_edits(base, base.where("k % 5 = 0"), t.orders.where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("k"), F.lit("added").alias("v")), ["k"])


@query("U07_canonical_set", "SELECT p_brand, array_to_string(list_sort(list_distinct(list(p_type))), '|') AS items, sha256(array_to_string(list_sort(list_distinct(list(p_type))), '|')) AS identity FROM part GROUP BY p_brand")
def _(t):
    return sets.canonical_set(t.part.select("p_brand", "p_type"), ["p_brand"], "p_type").select("p_brand", F.array_join("items", "|").alias("items"), "identity")


@query("U08_ordered_diff")
def _(t):
    a = t.conversations.select("conv_id", "turn", F.col("role").alias("item"))
    b = a.where("(conv_id + turn) % 4 <> 1")
    return sets.ordered_diff(a, b, "conv_id", "turn", "item")


@query("U09_proof_diff", f"SELECT change, count(*)::BIGINT AS n FROM (SELECT CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.v IS DISTINCT FROM b.v THEN 'changed' END AS change FROM ({_SNAP_A}) a FULL JOIN ({_SNAP_B}) b ON a.k = b.k) WHERE change IS NOT NULL GROUP BY change")
def _(t):
    return rel.keyed_diff(*_snapshots(t), ["k"], "v").groupBy("change").agg(F.count("*").alias("n"))


@query("U10_sequence_edits", "SELECT s_suppkey AS k, row_number() OVER (ORDER BY p, o, s_suppkey) - 1 AS pos FROM (SELECT s_suppkey, s_suppkey AS p, 1 AS o FROM supplier WHERE s_suppkey % 10 <> 3 AND s_suppkey <> 7 UNION ALL SELECT 7, 20, 0 UNION ALL SELECT 5000, 4, 0)")
def _(t):
    seq = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_suppkey").alias("pos"))
    ins = t.spark.createDataFrame([(7, 20), (5000, 4)], "k long, at long")
    return win.sequence_edit(seq, "k", "pos", t.supplier.where("s_suppkey % 10 = 3 or s_suppkey = 7").select(F.col("s_suppkey").alias("k")), ins).select("k", F.col("pos").cast("long").alias("pos"))
