"""Incremental queries and sinks over the test tables; batch forms have SQL, stateful streams are held against tests."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import tables as sink
from ..streaming import deltas as d
from ..iterate import shared_dir
from .registry import query


def _own(t, what: str) -> str:
    return f"{shared_dir(t.spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


@query("K01_publish_generation", "SELECT r_regionkey, r_name, true AS published, false AS again FROM region")
def _(t):
    store = sink.Generations(t.spark, _own(t, "generations"))
    first, again = store.publish("g1", t.region), store.publish("g1", t.region)
    return store.read("g1").withColumn("published", F.lit(first)).withColumn("again", F.lit(again))


@query("K02_replace_file_rows", "SELECT source, doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'new' ELSE 'old' END AS v FROM documents")
def _(t):
    path = _own(t, "files")
    base = t.documents.select("doc_id", F.lit("old").alias("v"), "source")
    sink.replace_partitions(base, path, "source")
    sink.replace_partitions(base.where("source in ('src1', 'src2')").withColumn("v", F.lit("new")), path, "source")
    return t.spark.read.schema(base.schema).parquet(path).select("source", "doc_id", "v")


@query("K03_publish_documentation", "SELECT count(*)::BIGINT AS documented, (SELECT count(*) FROM documents)::BIGINT - count(*)::BIGINT AS unmatched FROM labels")
def _(t):
    got = t.documents.join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return got.agg(F.count("quality").alias("documented"), F.count_if(F.col("quality").isNull()).alias("unmatched"))


@query("K04_path_alias", "SELECT l_partkey AS path, max(l_orderkey * 10 + l_linenumber) AS version FROM lineitem GROUP BY l_partkey")
def _(t):
    a = t.lineitem.select(F.col("l_partkey").alias("path"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("version"), "l_suppkey")
    return sink.latest_alias(a, "path", "version").select("path", "version")


@query("K05_code_edge_generation", "SELECT l_suppkey AS src, count(*)::BIGINT AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_suppkey")
def _(t):
    store = sink.Generations(t.spark, _own(t, "code"))
    store.publish("code", t.lineitem.where("l_returnflag = 'A'").groupBy(F.col("l_suppkey").alias("src")).agg(F.count("*").alias("n")))
    store.activate("code", lambda df: df.where("n <= 0").isEmpty())
    return store.read()


@query("K06_class_refs", "SELECT DISTINCT l_suppkey AS artifact, l_partkey AS target FROM lineitem")
def _(t):
    return t.lineitem.select(F.col("l_suppkey").alias("artifact"), F.col("l_partkey").alias("target")).distinct()


@query("K07_reconcile_deletions", "SELECT url, page_id FROM pages WHERE NOT starts_with(url, 'http://') OR page_id % 3 <> 0")
def _(t):
    p = t.pages.select("url", "page_id")
    present = p.groupBy("url").agg(F.max(F.col("page_id") % 3 != 0).alias("keep")).where("keep").select("url")
    return sink.reconcile(p, present, "url", "http://")


@query("K08_inventory_sweep", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING bool_and(o_orderkey % 2 <> 0)")
def _(t):
    o = t.orders.select("o_orderkey", "o_custkey")
    return sink.sweep(o, o.where("o_orderkey % 2 = 0"), "o_orderkey", "o_custkey", True)[1]


@query("K09_semantic_postings", "SELECT 'dep' AS posting, count(*)::BIGINT AS n FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) UNION ALL SELECT 'prefix', count(*)::BIGINT FROM (SELECT DISTINCT p_brand, l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey UNION SELECT DISTINCT p_brand || '.' || p_type, l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey)")
def _(t):
    rows = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    c = rows.select(F.col("l_orderkey").alias("file"), F.array("l_partkey").alias("deps"), F.array(F.concat_ws(".", "p_brand", "p_type")).alias("unresolved"))
    posts = sink.semantic_postings(c)
    count = lambda n, k: posts[k].agg(F.count("*").alias("n")).select(F.lit(n).alias("posting"), "n")
    return count("dep", "reverse").unionByName(count("prefix", "prefix"))


@query("K10_tree_edit", "SELECT o_orderkey AS k, o_totalprice + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS v FROM orders WHERE o_orderkey % 11 <> 0 OR o_orderkey % 7 = 0")
def _(t):
    from ..operators.layers import apply_edits

    base = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    return apply_edits(base, base.where("k % 11 = 0"), base.where("k % 7 = 0").withColumn("v", F.col("v") + 1), ["k"])


@query("K15_generation_rollback", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey < 3")
def _(t):
    store = sink.Generations(t.spark, _own(t, "rollback"))
    store.publish("a", t.nation.where("n_regionkey < 3").select("n_nationkey", "n_name"))
    store.publish("b", t.nation.select("n_nationkey", "n_name"))
    store.activate("a")
    store.activate("b", lambda df: df.count() > 0)
    store.rollback()
    return store.read()


@query("S19_journal_load", "SELECT event_id, event_type FROM events WHERE event_id % 10 <> 3")
def _(t):
    path = _own(t, "journal")
    line = F.to_json(F.struct("event_id", "event_type"))
    t.events.select(F.when(F.col("event_id") % 10 == 3, F.substring(line, 1, 9)).otherwise(line)).write.text(path)
    return sink.read_journal(t.spark, path, "event_id long, event_type string").where("_damaged is null").select("event_id", "event_type")


@query("T01_coalesced_deltas", "SELECT user_id, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM events GROUP BY user_id")
def _(t):
    return d.coalesce_deltas(t.events.select("user_id", "ts", "event_id", "value"), ["user_id"], "ts", "event_id").select("user_id", "value", "ts")


@query("T02_delta_admission", "SELECT change, count(*)::BIGINT AS n FROM (SELECT CASE WHEN doc_id % 6 = 0 THEN 'removed' WHEN doc_id % 5 = 0 THEN 'changed' END AS change FROM documents WHERE source IN ('src1', 'src4')) WHERE change IS NOT NULL GROUP BY change")
def _(t):
    state = t.documents.select("source", "doc_id", F.col("lang").alias("v"))
    snap = state.where("source in ('src1', 'src4') and doc_id % 6 <> 0").withColumn("v", F.when(F.col("doc_id") % 5 == 0, "xx").otherwise(F.col("v")))
    return d.admit(state, snap, "source", "doc_id", "v")[1].groupBy("change").agg(F.count("*").alias("n"))


@query("T03_affected_files", "SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 50 = 0 OR s_suppkey % 9 = 0 OR (s_suppkey > 0 AND (s_suppkey // 10) * 10 % 50 = 0 AND s_suppkey % 10 = 1)")
def _(t):
    s = t.supplier.select(F.col("s_suppkey").alias("file"))
    before = s.select("file", F.lit(1).alias("api"), F.lit(1).alias("body"))
    after = s.select("file", F.when(F.col("file") % 50 == 0, 2).otherwise(1).alias("api"), F.when(F.col("file") % 9 == 0, 2).otherwise(1).alias("body"))
    dep = s.where("file % 10 = 1").select(F.col("file").alias("src"), (F.col("file") - 1).alias("dst"))
    none = s.limit(0)
    return d.affected(before, after, dep, none.select("file", F.lit("").alias("name")), none.select("file", F.lit("").alias("export")))


@query("T04_maintained_observations", "SELECT c_custkey, count(o_orderkey)::BIGINT AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def _(t):
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t.customer.select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("T05_incomplete_scan_keeps", "SELECT o_orderkey, o_custkey FROM orders")
def _(t):
    o = t.orders.select("o_orderkey", "o_custkey")
    return sink.sweep(o, o.where("o_orderkey % 2 = 0"), "o_orderkey", "o_custkey", False)[0]


@query("T07_version_order", "SELECT user_id, count(*)::BIGINT AS n FROM (SELECT user_id, event_id, max(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events) WHERE before IS NULL OR event_id > before GROUP BY user_id")
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    got = t.events.select("user_id", "event_id", F.max("event_id").over(w).alias("before"))
    return got.where("before is null or event_id > before").groupBy("user_id").agg(F.count("*").alias("n"))


@query("T09_uncertainty_fence", "SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN 'UNKNOWN' ELSE 'FOUND' END AS status FROM documents")
def _(t):
    return d.fenced(t.documents.select("doc_id", (F.col("doc_id") % 4).alias("epoch"), F.lit("FOUND").alias("status")), 2).select("doc_id", "status")


@query("T10_staleness", "SELECT doc_id, CASE WHEN source = 'src2' THEN 'STALE' ELSE 'FOUND' END AS status FROM documents")
def _(t):
    s = t.documents.select("doc_id", "source", F.lit("FOUND").alias("status"))
    return d.uncertain(s, s.where("source = 'src2'").select("source").distinct(), "source").select("doc_id", "status")


@query("T11_result_validation", "SELECT o_custkey AS consumer, bool_and(o_orderkey % 13 <> 0) AS valid FROM orders GROUP BY o_custkey")
def _(t):
    proofs = t.orders.select(F.col("o_custkey").alias("consumer"), F.lit("orders").alias("domain"), F.col("o_orderkey").alias("key"), F.lit("v1").alias("identity"))
    now = t.orders.select(F.lit("orders").alias("domain"), F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 13 == 0, "v2").otherwise("v1").alias("identity"))
    return d.valid_results(proofs, now)
