"""Aggregates, graph walks, functions, sinks and incremental operators over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.fingerprint import fingerprint, identity, limbs, member, minus, plus
from ..operators import aggregates as ag
from ..operators import graph as g
from .registry import query

PT = "('0x' || substr(sha256({}), 1, 15))::BIGINT::DECIMAL(38,0)"


def canon_sql(*cols: str) -> str:
    """The SQL of functions.text.canonical for columns without nulls."""
    return " || ".join(f"length(({c})::VARCHAR)::VARCHAR || ':' || ({c})::VARCHAR" for c in cols)


def point_sql(domain: str, *cols: str) -> str:
    return PT.format(f"'{domain}|' || {canon_sql(*cols)}")


@query("A01_store_counts", "SELECT (SELECT count(*) FROM supplier)::BIGINT AS artifacts, (SELECT count(*) FROM part)::BIGINT AS symbols, (SELECT count(*) FROM lineitem)::BIGINT AS edges, (SELECT count(*) FROM (SELECT DISTINCT p_name FROM part))::BIGINT AS simple_names")
def _(t):
    one = lambda d, n: d.agg(F.count("*").alias(n)).withColumn("__k", F.lit(1))
    got = one(t.supplier, "artifacts").join(one(t.part, "symbols"), "__k").join(one(t.lineitem, "edges"), "__k").join(one(t.part.select("p_name").distinct(), "simple_names"), "__k")
    return got.drop("__k")


@query("A02_duplicate_class_report", "SELECT p_name, count(DISTINCT p_brand)::BIGINT AS owners, string_agg(DISTINCT p_brand || ' [' || p_type || ']', '; ' ORDER BY p_brand || ' [' || p_type || ']') AS labels FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) >= 2")
def _(t):
    d = t.part.select("p_name", "p_brand", F.concat("p_brand", F.lit(" ["), "p_type", F.lit("]")).alias("label"))
    return ag.conflict_report(d, "p_name", "p_brand", "label")


@query("A03_split_package_report", "SELECT p_type AS package, count(DISTINCT p_brand)::BIGINT AS owners, string_agg(DISTINCT p_brand, '; ' ORDER BY p_brand) AS labels FROM part GROUP BY p_type HAVING count(DISTINCT p_brand) >= 2")
def _(t):
    d = t.part.select(F.col("p_type").alias("package"), "p_brand", F.col("p_brand").alias("label"))
    return ag.conflict_report(d, "package", "p_brand", "label")


@query("A04_set_fingerprint", f"SELECT count(*)::BIGINT AS n, sum({point_sql('orders', 'o_orderkey', 'o_custkey')})::DECIMAL(38,0)::VARCHAR AS sum FROM orders")
def _(t):
    got = t.orders.agg(fingerprint("orders", "o_orderkey", "o_custkey").alias("fp"))
    return got.select("fp.n", F.col("fp.sum").cast("string").alias("sum"))


@query("A04b_fingerprint_replace", f"SELECT count(*)::BIGINT AS n, sum({point_sql('o', 'o_orderkey')})::DECIMAL(38,0)::VARCHAR AS sum FROM orders WHERE o_orderkey >= 100")
def _(t):
    whole, gone = (d.agg(fingerprint("o", "o_orderkey").alias(n)).withColumn("k", F.lit(1)) for d, n in ((t.orders, "a"), (t.orders.where("o_orderkey < 100"), "b")))
    v = minus(F.col("a"), F.col("b"))
    return whole.join(gone, "k").select(v.alias("v")).select("v.n", F.col("v.sum").cast("string").alias("sum"))


@query("A04c_full_identity")
def _(t):
    d = t.orders.select("o_orderstatus", member("orders", "o_orderkey", "o_custkey").alias("h"))
    return d.groupBy("o_orderstatus").agg(F.count("*").alias("n"), *limbs("h")).select("o_orderstatus", "n", identity().alias("identity"))


@query("A05_range_fingerprints", f"SELECT p_brand, substr(p_name, 1, 3) AS prefix, count(*)::BIGINT AS n, sum({point_sql('part', 'p_partkey', 'p_name')})::DECIMAL(38,0)::VARCHAR AS sum FROM part GROUP BY ALL")
def _(t):
    got = t.part.groupBy("p_brand", F.substring("p_name", 1, 3).alias("prefix")).agg(fingerprint("part", "p_partkey", "p_name").alias("fp"))
    return got.select("p_brand", "prefix", "fp.n", F.col("fp.sum").cast("string").alias("sum"))


@query("A06_refcounts", "SELECT l_partkey, count(*)::BIGINT AS refs FROM lineitem GROUP BY l_partkey")
def _(t):
    return ag.refcounts(t.lineitem, "l_partkey")


@query("A07_bounded_count", "SELECT least(count(*), 501)::BIGINT AS n FROM lineitem WHERE l_returnflag = 'R'")
def _(t):
    return ag.bounded_count(t.lineitem.where("l_returnflag = 'R'"), 500)


@query("A08_latency_percentiles", "SELECT event_type, count(*)::BIGINT AS n, list_sort(list(value))[((count(*) - 1) // 2 + 1)::INT] AS p50, list_sort(list(value))[ceil(0.95 * count(*))::INT] AS p95 FROM events GROUP BY event_type")
def _(t):
    return ag.discrete_percentiles(t.events, ["event_type"], "value")


@query("A09_class_histogram", "SELECT p_type, count(*)::BIGINT AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type")
def _(t):
    return t.part.groupBy("p_type").agg(F.count("*").alias("n")).where("n > 0").orderBy(F.desc("n"), "p_type")


_BUCKETS = f"SELECT (('0x' || substr(sha256({canon_sql('o_orderkey')}), 1, 2))::INT) AS bucket, count(*)::BIGINT AS n, sum({point_sql('m', 'o_orderkey', 'o_custkey')})::DECIMAL(38,0)::VARCHAR AS sum FROM orders GROUP BY 1"


@query("A10_merkle_buckets", _BUCKETS)
def _(t):
    return ag.merkle_buckets(t.orders, "m", "o_orderkey", "o_custkey").withColumn("sum", F.col("sum").cast("string"))


@query("A10b_merkle_root", f"SELECT sha256(string_agg(bucket || ':' || n || ':' || sum::VARCHAR, ',' ORDER BY bucket)) AS root FROM ({_BUCKETS})")
def _(t):
    return ag.merkle_root(ag.merkle_buckets(t.orders, "m", "o_orderkey", "o_custkey"))


@query("A11_definer_multimap", "SELECT p_name, count(DISTINCT p_brand)::INT AS n, arg_min(p_brand, (p_brand)) AS first, array_to_string(list_sort(list_distinct(list(p_brand))), ',') AS definers FROM part GROUP BY p_name")
def _(t):
    return ag.definers(t.part.select("p_name", "p_brand", F.col("p_brand").alias("pos")), "p_name", "p_brand", "pos").withColumn("definers", F.array_join("definers", ","))


@query("A12_conflict_table", "SELECT l_partkey, count(*)::INT AS n, min(l_suppkey) AS first FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) GROUP BY l_partkey HAVING count(*) >= 2")
def _(t):
    d = t.lineitem.select("l_partkey", "l_suppkey", F.col("l_suppkey").alias("pos"))
    return ag.definer_counts(d, "l_partkey", "l_suppkey", "pos").where("n >= 2").select("l_partkey", F.col("n").cast("int").alias("n"), "first")


@query("A13_disjoint_index", "SELECT l_partkey, min(l_suppkey) AS definer FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) GROUP BY l_partkey HAVING count(*) = 1")
def _(t):
    return t.lineitem.groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("n"), F.min("l_suppkey").alias("definer")).where("n = 1").drop("n")


@query("A14_min_distance", "SELECT l_partkey, min(l_linenumber) AS d FROM lineitem GROUP BY l_partkey HAVING min(l_linenumber) > 0")
def _(t):
    return t.lineitem.groupBy("l_partkey").agg(F.min("l_linenumber").alias("d")).where("d > 0")


@query("A15_ambiguity", "SELECT p_partkey, count(*) OVER (PARTITION BY p_name, p_type, p_size) AS same, count(*) OVER (PARTITION BY p_name, p_type, p_size) > 1 AS ambiguous FROM part")
def _(t):
    return ag.ambiguity(t.part.select("p_partkey", "p_name", "p_type", "p_size"), "p_name", "p_type", "p_size").select("p_partkey", "same", "ambiguous")


@query("A16_resolution_identity", f"SELECT p_brand, sha256(array_to_string(list_sort(list_distinct(list({canon_sql('p_name', 'p_type')}))), ',')) AS identity FROM part GROUP BY p_brand")
def _(t):
    return ag.sorted_digest(["p_brand"], t.part, "p_name", "p_type")


@query("A17_owner_sum", f"SELECT s_nationkey, count(*)::BIGINT AS n, sum({point_sql('s', 's_suppkey')})::DECIMAL(38,0)::VARCHAR AS sum FROM supplier GROUP BY s_nationkey")
def _(t):
    return t.supplier.groupBy("s_nationkey").agg(fingerprint("s", "s_suppkey").alias("fp")).select("s_nationkey", "fp.n", F.col("fp.sum").cast("string").alias("sum"))


@query("A18_range_sum", "SELECT count(*)::BIGINT AS n, sum(o_custkey)::BIGINT AS s FROM orders WHERE o_orderkey >= 1000 AND o_orderkey < 9000")
def _(t):
    return t.orders.where("o_orderkey >= 1000 and o_orderkey < 9000").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("s"))


@query("A19_aggregate_vector", f"SELECT p_brand, sum({point_sql('member', 'p_partkey')})::DECIMAL(38,0)::VARCHAR AS membership, sum({point_sql('api', 'p_partkey', 'p_name')})::DECIMAL(38,0)::VARCHAR AS api, sum({point_sql('ns', 'p_type')})::DECIMAL(38,0)::VARCHAR AS namespace, sum({point_sql('doc', 'p_size')})::DECIMAL(38,0)::VARCHAR AS documentation FROM part GROUP BY p_brand")
def _(t):
    fps = (("membership", fingerprint("member", "p_partkey")), ("api", fingerprint("api", "p_partkey", "p_name")), ("namespace", fingerprint("ns", "p_type")), ("documentation", fingerprint("doc", "p_size")))
    return t.part.groupBy("p_brand").agg(*[c.alias(n) for n, c in fps]).select("p_brand", *[F.col(f"{n}.sum").cast("string").alias(n) for n, _ in fps])


def _tree(t):
    """Nations over regions over one root, suppliers below nations: src depends on dst."""
    n = t.nation.select(F.concat(F.lit("N:"), "n_nationkey").alias("src"), F.concat(F.lit("R:"), "n_regionkey").alias("dst"))
    s = t.supplier.select(F.concat(F.lit("S:"), "s_suppkey").alias("src"), F.concat(F.lit("N:"), "s_nationkey").alias("dst"))
    return n.unionByName(s)


TREE = "SELECT 'N:' || n_nationkey AS src, 'R:' || n_regionkey AS dst FROM nation UNION ALL SELECT 'S:' || s_suppkey, 'N:' || s_nationkey FROM supplier"


def _nodes(e):
    return e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()


@query("A20_heights", f"WITH RECURSIVE e AS ({TREE}), h AS (SELECT dst AS id, 1 AS height FROM e UNION SELECT e.src, h.height + 1 FROM h JOIN e ON e.dst = h.id) SELECT id, max(height)::INT AS height FROM h GROUP BY id")
def _(t):
    e = _tree(t)
    return g.heights(e, _nodes(e))


@query("A21_posting_pack", "SELECT p_name, i // 256 AS run, max(p_partkey) AS last, count(*)::BIGINT AS ids FROM (SELECT p_name, p_partkey, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS i FROM part) GROUP BY ALL")
def _(t):
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("p_name").orderBy("p_partkey")) - 1
    return t.part.select("p_name", "p_partkey", F.floor(i / 256).alias("run")).groupBy("p_name", "run").agg(F.max("p_partkey").alias("last"), F.count("*").alias("ids"))


@query("A22_interpolated_quantile", "SELECT event_type, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY event_type")
def _(t):
    return t.events.groupBy("event_type").agg(F.percentile("value", 0.5).alias("median"), F.percentile("value", 0.95).alias("p95"))


@query("A23_string_aggregate", "SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types FROM part GROUP BY p_brand")
def _(t):
    return t.part.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("types"))


@query("A24_upsert_counter", "SELECT name, sum(value)::BIGINT AS value FROM (SELECT p_type AS name, 1 AS value FROM part UNION ALL SELECT event_type, 2 FROM events) GROUP BY name")
def _(t):
    return ag.upsert_counters(t.part.select(F.col("p_type").alias("name"), F.lit(1).alias("value")), t.events.select(F.col("event_type").alias("name"), F.lit(2).alias("value")))


@query("A25_duplicate_coordinates", "SELECT p_brand || ':' || p_name AS ga, count(DISTINCT p_partkey)::BIGINT AS owners, string_agg(DISTINCT 'dir' || p_partkey, '; ' ORDER BY 'dir' || p_partkey) AS labels FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) >= 2")
def _(t):
    return ag.conflict_report(t.part.select(F.concat_ws(":", "p_brand", "p_name").alias("ga"), "p_partkey", F.concat(F.lit("dir"), "p_partkey").alias("label")), "ga", "p_partkey", "label")


@query("A26_directory_chain_rollup", f"SELECT directory, count(*)::BIGINT AS files, count(*) FILTER (page_id % 2 = 0)::BIGINT AS pending, sum({point_sql('page', 'page_id')})::DECIMAL(38,0)::VARCHAR AS sum FROM (SELECT page_id, array_to_string(string_split(url, '/')[1:i], '/') AS directory FROM pages, unnest(range(0, len(string_split(url, '/')))) r(i)) GROUP BY directory")
def _(t):
    got = ag.chain_rollup(t.pages.select("page_id", "url"), "url", F.count("*").alias("files"), F.count_if(F.col("page_id") % 2 == 0).alias("pending"), fingerprint("page", "page_id").alias("fp"))
    return got.select("directory", "files", "pending", F.col("fp.sum").cast("string").alias("sum"))


@query("A27_freshness", "WITH c AS (SELECT o_custkey, min(o_orderkey) AS c FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), s AS (SELECT o_custkey, max(o_orderkey) AS s FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) SELECT o_custkey, coalesce(c >= s, false) AS fresh FROM s LEFT JOIN c USING (o_custkey)")
def _(t):
    o = t.orders.select("o_custkey", F.col("o_orderkey").alias("mtime"), "o_orderstatus")
    return ag.fresh(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "o_custkey")


@query("A28_namespace_identity", f"SELECT source, sha256(array_to_string(list_sort(list_distinct(list({canon_sql('lang', 'doc_id')}))), ',')) AS identity FROM documents GROUP BY source")
def _(t):
    return ag.sorted_digest(["source"], t.documents, "lang", "doc_id")


@query("G01_relationship_closure", f"WITH RECURSIVE e AS ({TREE}), r AS (SELECT src, dst AS id, 1 AS level FROM e WHERE src LIKE 'S:1%' UNION SELECT r.src, e.dst, level + 1 FROM r JOIN e ON e.src = r.id WHERE level < 3) SELECT id, min(level)::INT AS level FROM r GROUP BY id")
def _(t):
    e = _tree(t).withColumn("kind", F.lit("extends"))
    roots = e.where(F.col("src").startswith("S:1")).select(F.col("src").alias("id"))
    return g.closure(e, roots, 3, ["extends"])


@query("G01b_no_kinds_no_closure", "SELECT 0::BIGINT AS n")
def _(t):
    e = _tree(t).withColumn("kind", F.lit("extends"))
    return g.closure(e, e.select(F.col("src").alias("id")), 3, []).agg(F.count("*").alias("n"))


@query("G02_unresolved_closure", f"WITH RECURSIVE e AS ({TREE}), r AS (SELECT dst AS id, 1 AS level FROM e WHERE src LIKE 'S:2%' UNION SELECT e.dst, level + 1 FROM r JOIN e ON e.src = r.id WHERE level < 2) SELECT DISTINCT id FROM r WHERE id NOT IN (SELECT 'N:' || n_nationkey FROM nation WHERE n_nationkey < 20)")
def _(t):
    e = _tree(t)
    got = g.reach(e, e.where(F.col("src").startswith("S:2")).select(F.col("src").alias("id")), 2)
    known = t.nation.where("n_nationkey < 20").select(F.concat(F.lit("N:"), "n_nationkey").alias("id"))
    return got.select("id").distinct().join(known, "id", "left_anti")


@query("G04_hierarchy_down", f"WITH RECURSIVE e AS ({TREE}), r AS (SELECT src AS id, 1 AS level FROM e WHERE dst = 'R:2' UNION SELECT e.src, level + 1 FROM r JOIN e ON e.dst = r.id WHERE level < 3) SELECT id, min(level)::INT AS level FROM r GROUP BY id")
def _(t):
    e = _tree(t)
    return g.reach(e, t.spark.createDataFrame([("R:2",)], "id string"), 3, outgoing=False).select("id", "level")


@query("G05_references_in", "SELECT DISTINCT 'O:' || l_orderkey AS id, 1 AS level FROM lineitem WHERE l_partkey = 7")
def _(t):
    e = t.lineitem.select(F.concat(F.lit("O:"), "l_orderkey").alias("src"), F.concat(F.lit("P:"), "l_partkey").alias("dst"))
    return g.reach(e, t.spark.createDataFrame([("P:7",)], "id string"), 1, outgoing=False).select("id", "level")


@query("G06_reverse_closure", f"WITH RECURSIVE e AS (SELECT * FROM ({TREE}) WHERE src NOT IN ('N:3', 'N:8')), r AS (SELECT 'R:3' AS id UNION SELECT e.src FROM r JOIN e ON e.dst = r.id) SELECT id FROM r")
def _(t):
    return g.reverse_closure(_tree(t), t.spark.createDataFrame([("R:3",)], "id string"), t.spark.createDataFrame([("N:3",), ("N:8",)], "id string"))


@query("G07_hypothetical_impact", f"WITH RECURSIVE e AS ({TREE}), r AS (SELECT 'N:5' AS id UNION SELECT 'N:6' UNION SELECT e.src FROM r JOIN e ON e.dst = r.id) SELECT id FROM r UNION SELECT 'S:' || s_suppkey FROM supplier WHERE s_acctbal < 0")
def _(t):
    unknown = t.supplier.where("s_acctbal < 0").select(F.concat(F.lit("S:"), "s_suppkey").alias("id"))
    return g.reverse_closure(_tree(t), t.spark.createDataFrame([("N:5",), ("N:6",)], "id string").unionByName(unknown))


@query("G09_descendants", f"WITH RECURSIVE e AS ({TREE}), r AS (SELECT src AS id FROM e WHERE dst = 'R:1' UNION SELECT e.src FROM r JOIN e ON e.dst = r.id) SELECT id FROM r")
def _(t):
    down = _tree(t).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return g.descendants(down, t.spark.createDataFrame([("R:1",)], "id string"))


_FOLD = "sha256('R:' || n_regionkey || '|')"


@query("G10_folded_identity", f"WITH n AS (SELECT n_nationkey, sha256('N:' || n_nationkey || '|' || {_FOLD}) AS i FROM nation) SELECT 'R:' || r_regionkey AS id, sha256('R:' || r_regionkey || '|') AS identity FROM region UNION ALL SELECT 'N:' || n_nationkey, i FROM n UNION ALL SELECT 'S:' || s_suppkey, sha256('S:' || s_suppkey || '|' || i) FROM supplier JOIN n ON n_nationkey = s_nationkey")
def _(t):
    e = _tree(t)
    return g.folded_identities(e, _nodes(e).withColumn("own", F.col("id")))


_CYC = "SELECT s_suppkey AS src, CASE WHEN s_suppkey % 10 = 9 THEN s_suppkey - 3 ELSE s_suppkey + 1 END AS dst FROM supplier"


def _cyclic(t):
    return t.supplier.select(F.col("s_suppkey").alias("src"), F.when(F.col("s_suppkey") % 10 == 9, F.col("s_suppkey") - 3).otherwise(F.col("s_suppkey") + 1).alias("dst"))


@query("G13_topological_order", f"WITH RECURSIVE e AS ({TREE}), h AS (SELECT dst AS id, 0 AS level FROM e UNION SELECT e.src, h.level + 1 FROM h JOIN e ON e.dst = h.id) SELECT id, max(level)::INT AS level FROM h GROUP BY id")
def _(t):
    e = _tree(t)
    return g.topological_levels(e, _nodes(e))


@query("G12_cycles", f"WITH RECURSIVE e AS ({_CYC}), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst) SELECT DISTINCT src AS id FROM r WHERE src = dst")
def _(t):
    return g.cycles(_cyclic(t))


@query("G17_strong_components", f"WITH RECURSIVE e AS ({_CYC}), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst), n AS (SELECT src AS id FROM e UNION SELECT dst FROM e), c AS (SELECT a.src AS id, min(a.dst) AS c FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src) SELECT n.id, least(n.id, coalesce(c.c, n.id)) AS comp, n.id <> 37 AND n.id NOT IN (SELECT src FROM r WHERE dst = 37) AS \"final\" FROM n LEFT JOIN c ON c.id = n.id")
def _(t):
    e = _cyclic(t)
    return g.components(e, _nodes(e), t.spark.createDataFrame([(37,)], "id long")).select("id", "comp", "final")


@query("G18_overlay_cycles", f"WITH RECURSIVE e AS ({_CYC}), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst), o AS (SELECT DISTINCT src FROM r WHERE src = dst) SELECT src, dst FROM e WHERE src IN (SELECT src FROM o) AND dst IN (SELECT src FROM o)")
def _(t):
    on = g.cycles(_cyclic(t))
    e = _cyclic(t)
    return e.join(on.withColumnRenamed("id", "src"), "src", "left_semi").join(on.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


@query("G11_dependency_walk", "SELECT s_nationkey AS g, arg_min(s_suppkey, (level, s_suppkey)) AS winner, count(*)::BIGINT - 1 AS losers FROM (SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 2 END AS level FROM supplier) GROUP BY s_nationkey")
def _(t):
    from ..operators.layers import first_winner

    d = t.supplier.select(F.col("s_nationkey").alias("g"), F.col("s_suppkey").alias("winner"), F.when(F.col("s_suppkey") % 2 == 0, 1).otherwise(2).alias("level"))
    n = d.groupBy("g").agg((F.count("*") - 1).alias("losers"))
    return first_winner(d, ["g"], "level", "winner").join(n, "g").select("g", "winner", "losers")


@query("G03_override_parents", "WITH RECURSIVE up AS (SELECT 'N:' || n_nationkey AS child, 'R:' || n_regionkey AS parent, 1 AS level FROM nation) SELECT child, parent, level FROM up")
def _(t):
    return g.closure_pairs(_tree(t).where(F.col("src").startswith("N:")), "src", "dst").select(F.col("src").alias("child"), F.col("dst").alias("parent"), "level")


@query("G14_inherited_member", "SELECT 'S:' || s_suppkey AS src, CASE WHEN s_suppkey % 4 = 0 THEN 'S:' || s_suppkey WHEN s_nationkey % 2 = 0 THEN 'N:' || s_nationkey ELSE 'R:' || n_regionkey END AS found_in, CASE WHEN s_suppkey % 4 = 0 THEN 0 WHEN s_nationkey % 2 = 0 THEN 1 ELSE 2 END AS levels FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def _(t):
    from ..operators.relations import resolve_inherited

    e = _tree(t)
    want = t.supplier.select(F.concat(F.lit("S:"), "s_suppkey").alias("src")).select("src", F.col("src").alias("owner"), F.lit("m").alias("name"))
    s = t.supplier.where("s_suppkey % 4 = 0").select(F.concat(F.lit("S:"), "s_suppkey").alias("owner"), F.lit(1).alias("flags"))
    n = t.nation.select(F.concat(F.lit("N:"), "n_nationkey").alias("owner"), F.when(F.col("n_nationkey") % 2 == 0, 1).otherwise(2).alias("flags"))
    r = t.region.select(F.concat(F.lit("R:"), "r_regionkey").alias("owner"), F.lit(4).alias("flags"))
    members = s.unionByName(n).unionByName(r).select("owner", F.lit("m").alias("name"), F.col("owner").alias("id"), "flags")
    return resolve_inherited(want, members, e.select(F.col("src").alias("child"), F.col("dst").alias("parent"))).select("src", "found_in", "levels")


@query("G15_inherit_doc", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'see ' || coalesce((SELECT lang FROM documents p WHERE p.doc_id = d.doc_id + 1), '') ELSE lang END AS doc FROM documents d")
def _(t):
    d = t.documents.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "see {@inheritDoc}").otherwise(F.col("lang")).alias("doc"))
    up = t.documents.select((F.col("doc_id") - 1).alias("doc_id"), F.col("lang").alias("up"))
    return d.join(up, "doc_id", "left").select("doc_id", F.replace("doc", F.lit("{@inheritDoc}"), F.coalesce("up", F.lit(""))).alias("doc"))


@query("G16_receiver_hierarchy", f"WITH RECURSIVE e AS ({TREE}), r AS (SELECT src AS root, dst AS id, 1 AS level FROM e WHERE src LIKE 'S:%' UNION SELECT r.root, e.dst, level + 1 FROM r JOIN e ON e.src = r.id) SELECT root, string_agg(id, '>' ORDER BY level, id) AS owners FROM r GROUP BY root")
def _(t):
    e = _tree(t)
    got = g.reach(e, e.where(F.col("src").startswith("S:")).select(F.col("src").alias("id")), 20)
    return got.groupBy("root").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", "id"))), lambda x: x["id"]), ">").alias("owners"))


@query("G08_propagation", "SELECT 'R:' || r_regionkey AS id FROM region WHERE r_regionkey = 1 UNION ALL SELECT 'N:' || n_nationkey FROM nation WHERE n_regionkey = 1 AND n_nationkey % 2 = 0 UNION ALL SELECT 'S:' || s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 1 AND n_nationkey % 2 = 0")
def _(t):
    e = _tree(t)
    states = g.heights(e, _nodes(e)).withColumn("result", F.lit("old"))

    def recompute(ids, states, edges):
        # nations with an odd number have the same result again: their suppliers are not entered
        odd = F.col("id").startswith("N:") & (F.substring("id", 3, 9).cast("int") % 2 == 1)
        return ids.select("id", F.when(odd, "old").otherwise("new").alias("result"))

    return g.propagate(e, states, t.spark.createDataFrame([("R:1",)], "id string"), recompute)[1]


@query("X01_grams", "SELECT gram, count(*)::BIGINT AS n FROM (SELECT DISTINCT p_partkey, substr(p_name, i, 2) AS gram FROM part, unnest(range(1, length(p_name))) r(i)) GROUP BY gram")
def _(t):
    return t.part.select(F.explode(tx.grams("p_name", 2)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query("X02_dotted_prefixes", "SELECT p_partkey, p_brand AS prefix FROM part UNION ALL SELECT p_partkey, p_brand || '.' || p_type FROM part")
def _(t):
    return t.part.select("p_partkey", F.explode(tx.dotted_prefixes(F.concat_ws(".", "p_brand", "p_type"))).alias("prefix"))


@query("X03_names", "SELECT p_partkey, p_name AS simple, p_brand || '.' || p_type AS package FROM part")
def _(t):
    fqn = F.concat_ws(".", "p_brand", "p_type", "p_name")
    return t.part.select("p_partkey", tx.simple_name(fqn).alias("simple"), tx.package_of(fqn).alias("package"))


@query("X04_hashes", "SELECT p_partkey, sha256(p_name) AS s256, sha1(p_name) AS s1, lpad(lower(to_hex(p_partkey)), 8, '0') AS hex8 FROM part")
def _(t):
    return t.part.select("p_partkey", F.sha2("p_name", 256).alias("s256"), F.sha1("p_name").alias("s1"), tx.hex_padded("p_partkey", 8).alias("hex8"))


@query("X05_bits", "SELECT p_partkey, (p_size & 6)::INT AS a, (p_size | 9)::INT AS o, (p_size << 2)::INT AS l FROM part")
def _(t):
    return t.part.select("p_partkey", F.col("p_size").bitwiseAND(6).alias("a"), F.col("p_size").bitwiseOR(9).alias("o"), F.shiftleft("p_size", 2).alias("l"))


@query("X06_json", "SELECT event_id, (props->>'k')::INT AS k, coalesce(props->>'missing', event_type) AS c FROM events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), "event_type").alias("c"))


@query("X07_arrays", "SELECT p_name, array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), ',') AS words, len(string_split(p_name, ' '))::INT AS n FROM (SELECT DISTINCT p_name FROM part)")
def _(t):
    w = F.split("p_name", " ")
    return t.part.select("p_name").distinct().select("p_name", F.array_join(F.array_sort(F.array_distinct(w)), ",").alias("words"), F.size(w).alias("n"))


@query("X08_canonical_digest", f"SELECT p_partkey, sha256({canon_sql('p_name', 'p_size')}) AS d FROM part")
def _(t):
    return t.part.select("p_partkey", tx.digest("p_name", "p_size").alias("d"))


@query("X09_like_escape", "SELECT event_id FROM events WHERE props LIKE '%\"k\": 6_}' ESCAPE '!'")
def _(t):
    return t.events.where(F.expr("props LIKE '%\"k\": 6_}' ESCAPE '!'")).select("event_id")


@query("X10_offset_position", "SELECT doc_id, (length(substr(text, 1, 200)) - length(replace(substr(text, 1, 200), chr(10), '')))::INT AS line FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.line_and_column("text", F.lit(200))["line"].alias("line"))


@query("X11_doc_markdown")
def _(t):
    doc = F.concat(F.lit("{@code x} <p>see <b>"), "p_name", F.lit("</b>\n@param a "), "p_type", F.lit("\n@return b &lt;T&gt;"))
    return t.part.select("p_partkey", tx.doc_markdown(doc).alias("doc"))


@query("X12_descriptors", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'int,java.lang.String[],long' ELSE 'a.B.C,double[][]' END AS params FROM part")
def _(t):
    d = F.when(F.col("p_size") % 2 == 0, "(I[Ljava/lang/String;J)V").otherwise("(La/B$C;[[D)I")
    return t.part.select("p_partkey", F.array_join(tx.descriptor_parameters(d), ",").alias("params"))


@query("X13_map_merge", "SELECT p_partkey, 'a=' || p_type || ',b=' || p_size || ',c=3' AS m FROM part")
def _(t):
    m = F.map_concat(F.create_map(F.lit("b"), F.col("p_size").cast("string"), F.lit("a"), F.col("p_type")), F.create_map(F.lit("c"), F.lit("3")))
    return t.part.select("p_partkey", F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("m"))


@query("X14_fingerprint_union", f"SELECT count(*)::BIGINT AS n, sum({point_sql('o', 'o_orderkey')})::DECIMAL(38,0)::VARCHAR AS sum FROM orders")
def _(t):
    a, b = (t.orders.where(c).agg(fingerprint("o", "o_orderkey").alias(n)).withColumn("k", F.lit(1)) for c, n in (("o_orderkey % 2 = 0", "a"), ("o_orderkey % 2 = 1", "b")))
    return a.join(b, "k").select(plus(F.col("a"), F.col("b")).alias("v")).select("v.n", F.col("v.sum").cast("string").alias("sum"))
