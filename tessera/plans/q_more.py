"""Walks, live state, records and further functions over the test tables, and the query tools over a catalog of them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as tx
from ..iterate import shared_dir
from ..operators import aggregates as ag
from ..operators import search as s
from ..operators import sets, walks
from ..operators.layers import apply_edits, unbuilt
from ..sources import records
from ..sources import tables as sink
from ..streaming import live
from .registry import query
from .tools import Catalog, ok, reassemble, respond


def _own(t, what: str) -> str:
    return f"{shared_dir(t.spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def _named(prefix: str, c):
    return F.concat(F.lit(prefix), (F.col(c) if isinstance(c, str) else c).cast("string"))


# -- walks ---------------------------------------------------------------------------------------------------------


def _methods(t):
    low = t.supplier.select(_named("S", "s_suppkey").alias("owner"), F.lit("(I)V").alias("descriptor"), F.when(F.col("s_suppkey") % 4 == 0, 8).otherwise(1).alias("flags"), _named("p", F.col("s_suppkey") % 2).alias("package"))
    n_flags = F.when(F.col("n_nationkey") % 5 == 0, 2).when(F.col("n_nationkey") % 3 == 0, 0).otherwise(4)
    n = t.nation.select(_named("N", "n_nationkey").alias("owner"), F.when(F.col("n_nationkey") % 2 == 0, "(I)J").otherwise("(J)V").alias("descriptor"), n_flags.alias("flags"), _named("p", F.col("n_nationkey") % 2).alias("package"))
    r = t.region.select(_named("R", "r_regionkey").alias("owner"), F.lit("(I)V").alias("descriptor"), F.lit(1).alias("flags"), F.lit("q").alias("package"))
    return low.unionByName(n).unionByName(r).select(F.concat("owner", F.lit(".m")).alias("id"), "owner", F.lit("m").alias("name"), "descriptor", "flags", "package")


def _supers(t):
    up = t.supplier.select(_named("S", "s_suppkey").alias("child"), _named("N", "s_nationkey").alias("parent"))
    return up.unionByName(t.nation.select(_named("N", "n_nationkey").alias("child"), _named("R", "n_regionkey").alias("parent")))


@query(
    "G03b_transitive_override_parents",
    """SELECT 'S' || s_suppkey || '.m' AS id, 'N' || n_nationkey || '.m' AS parent_id, 1 AS level FROM supplier JOIN nation ON n_nationkey = s_nationkey
      WHERE s_suppkey % 4 <> 0 AND n_nationkey % 2 = 0 AND n_nationkey % 5 <> 0 AND (n_nationkey % 3 <> 0 OR s_suppkey % 2 = n_nationkey % 2)
    UNION ALL SELECT 'S' || s_suppkey || '.m', 'R' || n_regionkey || '.m', 2 FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 4 <> 0
    UNION ALL SELECT 'N' || n_nationkey || '.m', 'R' || n_regionkey || '.m', 1 FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey % 5 <> 0""",
)
def _(t):
    return walks.override_parents(_methods(t), _supers(t))


_SHARED = """WITH s AS (SELECT n_nationkey AS n, n_regionkey AS r, 'shared' || (n_nationkey % 5) AS name, 'v' || n_nationkey AS version FROM nation),
f AS (SELECT name, CASE WHEN name = 'shared4' THEN 'direct' ELSE arg_min(version, r * 1000 + n) END AS won FROM s GROUP BY name)"""


def _dependencies(t):
    row = "src string, dst string, version string, scope string, pos int"
    scope = F.when(F.col("n_nationkey") % 2 == 1, "test").otherwise("compile")
    r = t.region.select(F.lit("app").alias("src"), _named("r", "r_regionkey").alias("dst"), _named("v", F.col("r_regionkey") % 2).alias("version"), F.lit("compile").alias("scope"), F.col("r_regionkey").cast("int").alias("pos"))
    n = t.nation.select(_named("r", "n_regionkey").alias("src"), _named("n", "n_nationkey").alias("dst"), F.lit("v1").alias("version"), scope.alias("scope"), F.col("n_nationkey").cast("int").alias("pos"))
    s = t.nation.select(_named("n", "n_nationkey").alias("src"), _named("shared", F.col("n_nationkey") % 5).alias("dst"), _named("v", "n_nationkey").alias("version"), scope.alias("scope"), F.lit(0).alias("pos"))
    return t.spark.createDataFrame([("app", "shared4", "direct", "compile", 99)], row).unionByName(r).unionByName(n).unionByName(s)


@query(
    "G11b_mediated_dependencies",
    f"""{_SHARED} SELECT 'r' || r_regionkey AS name, 'v' || (r_regionkey % 2) AS version, true AS winner, NULL AS reason, 1 AS level FROM region
    UNION ALL SELECT 'shared4', 'direct', true, NULL, 1 UNION ALL SELECT 'n' || n_nationkey, 'v1', true, NULL, 2 FROM nation UNION ALL SELECT name, won, true, NULL, 3 FROM f WHERE name <> 'shared4'
    UNION ALL SELECT s.name, version, false, 'conflict with ' || won, 3 FROM s JOIN f USING (name) WHERE version <> won""",
)
def _(t):
    return walks.dependency_walk(_dependencies(t), "app")[0]


@query(
    "G11c_scope_order",
    f"""{_SHARED}, w AS (SELECT 'compile' AS scope, 1 AS level, r_regionkey * 1000 AS way, 'r' || r_regionkey AS name, 'v' || (r_regionkey % 2) AS version FROM region UNION ALL SELECT 'compile', 1, 99000, 'shared4', 'direct'
      UNION ALL SELECT CASE WHEN n_nationkey % 2 = 1 THEN 'test' ELSE 'compile' END, 2, n_regionkey * 1000 + n_nationkey, 'n' || n_nationkey, 'v1' FROM nation
      UNION ALL SELECT CASE WHEN n % 2 = 1 THEN 'test' ELSE 'compile' END, 3, r * 1000 + n, name, version FROM s JOIN f USING (name) WHERE version = won)
    SELECT scope, (row_number() OVER (PARTITION BY scope ORDER BY level, way) - 1)::INT AS place, name, version FROM w""",
)
def _(t):
    return walks.dependency_walk(_dependencies(t), "app")[1]


@query(
    "G15b_recursive_inherit_doc",
    """SELECT d.doc_id AS id, CASE d.doc_id % 3 WHEN 1 THEN d.lang WHEN 2 THEN 'as ' || coalesce(p.lang, '') ELSE 'see ' || coalesce('as ' || g.lang, '') END AS doc
    FROM documents d LEFT JOIN documents p ON p.doc_id = d.doc_id - 1 LEFT JOIN documents g ON g.doc_id = d.doc_id - 2""",
)
def _(t):
    asks = F.when(F.col("doc_id") % 3 == 1, F.col("lang")).when(F.col("doc_id") % 3 == 2, "as {@inheritDoc}").otherwise("see {@inheritDoc}")
    up = t.documents.select(F.col("doc_id").alias("id"), (F.col("doc_id") - 1).alias("parent"), F.lit(0).alias("pos"))
    return walks.inherited_docs(t.documents.select(F.col("doc_id").alias("id"), asks.alias("doc")), up)


@query(
    "G16b_receiver_with_arguments",
    """SELECT 'S' || s_suppkey AS root, CASE WHEN s_nationkey <> 7 THEN 'S' || s_suppkey || '; N' || s_nationkey || '<Box<S' || s_suppkey || '>>; R' || n_regionkey || '<List<Box<S' || s_suppkey || '>>>' END AS owners
    FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
)
def _(t):
    none, one = F.array().cast("array<string>"), lambda c: F.array(c)
    s = t.supplier.select(_named("S", "s_suppkey").alias("owner"), _named("N", "s_nationkey").alias("parent"))
    n = t.nation.select(_named("N", "n_nationkey").alias("owner"), _named("R", "n_regionkey").alias("parent"), (F.col("n_nationkey") != 7).alias("complete"))
    r = t.region.select(_named("R", "r_regionkey").alias("owner"))
    owners = s.select("owner", none.alias("variables"), F.lit(True).alias("complete")).unionByName(n.select("owner", one(F.lit("A")).alias("variables"), "complete")).unionByName(r.select("owner", one(F.lit("B")).alias("variables"), F.lit(True).alias("complete")))
    supers = s.select("owner", F.lit(0).alias("pos"), "parent", one(F.concat(F.lit("Box<"), "owner", F.lit(">"))).alias("arguments")).unionByName(n.select("owner", F.lit(0).alias("pos"), "parent", one(F.lit("List<A>")).alias("arguments")))
    got = walks.receiver_hierarchy(s.select(F.col("owner").alias("root"), "owner", none.alias("arguments")), supers, owners)
    return got.select("root", F.array_join("owners", "; ").alias("owners"))


# -- live state ----------------------------------------------------------------------------------------------------


@query(
    "T01b_publish_queue",
    """WITH l AS (SELECT user_id, max(event_id) AS version, arg_max(event_type, event_id) AS digest, arg_max(length(props), event_id) AS size FROM events GROUP BY user_id),
    c AS (SELECT *, sum(size) OVER (ORDER BY version DESC, user_id) AS total FROM l WHERE NOT (user_id % 2 = 0 AND digest = 'click'))
    SELECT user_id, version, digest FROM c WHERE total <= 1000""",
)
def _(t):
    d = t.events.select("user_id", F.col("event_id").alias("version"), F.col("event_type").alias("digest"), F.length("props").alias("size"))
    state = t.events.where("user_id % 2 = 0").select("user_id", F.lit("click").alias("digest")).distinct()
    return live.publish_queue(d, state, ["user_id"], "version", "digest", "size", 1000).select("user_id", "version", "digest")


@query(
    "T04c_refreshed_observations",
    """WITH n AS (SELECT c_custkey, count(o_orderkey) FILTER (o_orderkey % 2 = 0) AS n1, count(o_orderkey) FILTER (o_orderkey % 2 = 1) AS n2, row_number() OVER (ORDER BY c_custkey DESC) <= 512 AS kept FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)
    SELECT c_custkey, CASE WHEN kept AND n2 > 0 THEN n1 + n2 ELSE nullif(n1, 0) END AS n, CASE WHEN kept THEN 'FOUND' ELSE 'UNKNOWN' END AS status FROM n""",
)
def _(t):
    """Subscribed counts after a second half of the orders is published; the 512 last asked for are kept."""
    orders = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    count = lambda d: d.groupBy("c_custkey").agg(F.count("*").alias("n"))
    asked = t.customer.select("c_custkey", F.col("c_custkey").alias("at"))
    kept = live.subscribed(asked.limit(0), asked, "c_custkey", "at", 512)
    seen = kept.join(count(orders.where("o_orderkey % 2 = 0")), "c_custkey", "left").select("c_custkey", "n", "status")
    return live.refreshed(seen, orders.where("o_orderkey % 2 = 1"), "c_custkey", lambda keys: count(orders.join(keys, "c_custkey", "left_semi")), "n")


_WATCH = "CASE WHEN event_id % 1000 = 500 THEN 'overflow' WHEN event_id % 2500 = 700 THEN 'reconcile' WHEN event_type = 'purchase' THEN 'delete' WHEN event_type = 'signup' THEN 'create' ELSE 'modify' END"


@query(
    "T06_live_source_state",
    f"""WITH e AS (SELECT event_id AS seq, user_id, {_WATCH} AS kind FROM events), m AS (SELECT max(seq) FILTER (kind = 'overflow') AS lost, max(seq) FILTER (kind = 'reconcile') AS checked, count(*) FILTER (kind = 'overflow') AS epoch FROM e),
    l AS (SELECT user_id, max(seq) AS seq, arg_max(kind, seq) AS kind FROM e WHERE kind NOT IN ('overflow', 'reconcile') GROUP BY user_id)
    SELECT user_id AS path, kind <> 'delete' AS present, epoch, lost IS NULL OR seq > lost OR coalesce(checked > lost, false) AS trusted FROM l, m""",
)
def _(t):
    e = t.events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("path"), F.expr(_WATCH).alias("kind"))
    return live.live_state(e)


@query(
    "T08_debounced",
    """WITH e AS (SELECT user_id, datesub('second', TIMESTAMP '2024-01-01', ts) AS s FROM events), b AS (SELECT *, CASE WHEN s - lag(s) OVER w < 21600 THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s)),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS burst FROM b), p AS (SELECT *, (s - min(s) OVER (PARTITION BY user_id, burst)) // 86400 AS part FROM g)
    SELECT user_id, min(s) AS "first", max(s) AS "last", count(*) AS n FROM p GROUP BY user_id, burst, part""",
)
def _(t):
    e = t.events.select("user_id", F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)").alias("s"))
    return live.debounced(e, "user_id", "s", 21600, 86400)


@query(
    "T10b_stale_descendants",
    """WITH RECURSIVE d(k) AS (SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT unnest([2 * k + 1, 2 * k + 2]) FROM d WHERE k < 500)
    SELECT doc_id, CASE WHEN source IN (SELECT 'src' || k FROM d) THEN NULL ELSE lang END AS identity, CASE WHEN source = 'src1' THEN 'STALE' ELSE 'FOUND' END AS status FROM documents""",
)
def _(t):
    k = t.spark.range(1001)
    tree = k.select(_named("src", "id").alias("src"), F.explode(F.array(_named("src", F.col("id") * 2 + 1), _named("src", F.col("id") * 2 + 2))).alias("dst"))
    s = t.documents.select("doc_id", "source", F.col("lang").alias("identity"), F.lit("FOUND").alias("status"))
    return live.stale(s, t.spark.createDataFrame([("src1",)], "source string"), tree, "source", "identity").select("doc_id", "identity", "status")


@query("L09_dispatch_order", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC, o_orderkey)::INT AS place FROM orders")
def _(t):
    """The order of each session's queue."""
    return live.dispatched(t.orders.select("o_custkey", "o_orderkey", "o_orderpriority"), "o_custkey", "o_orderpriority", "o_orderkey").select("o_custkey", "o_orderkey", "place")


# -- records -------------------------------------------------------------------------------------------------------


@query(
    "K11_memo_lookup",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 THEN c_name END AS result,
    CASE WHEN c_custkey % 7 = 0 THEN 'UNKNOWN' WHEN c_custkey % 3 = 0 THEN 'MISS' WHEN c_custkey % 5 = 0 THEN 'CHANGED' ELSE 'HIT' END AS reason FROM customer""",
)
def _(t):
    c = t.customer.select("c_custkey", F.col("c_mktsegment").alias("identity"), F.col("c_name").alias("result"))
    first, rest = c.where("c_custkey % 2 = 0").withColumn("result", F.lit("old")), c.where("c_custkey % 3 <> 0")
    memos = records.keep(first.where("c_custkey % 3 <> 0"), rest, "c_custkey")
    wanted = c.select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, None).when(F.col("c_custkey") % 5 == 0, "other").otherwise(F.col("identity")).alias("identity"))
    return records.look_up(memos, wanted, "c_custkey", "identity")


@query("K12_request_log", "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY event_type")
def _(t):
    path = _own(t, "log")
    rows = t.events.select("event_id", "event_type")
    records.write_log(rows.where("event_id % 2 = 0"), path)
    records.write_log(rows.where("event_id % 2 = 1"), path)
    return records.read_log(t.spark, path, "event_id long, event_type string").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def _models(t) -> dict:
    """One model for each thousand suppliers of a nation, written as JSON lines and read again."""
    s = t.supplier.select(F.concat(F.lit("n"), "s_nationkey", F.lit("-"), F.floor(F.col("s_suppkey") / 1000)).alias("root"), "s_suppkey", "s_name")
    one = s.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("all"))
    model = F.struct(
        "root",
        F.array(F.struct(F.col("root").alias("id"), F.concat("root", F.lit("/pom")).alias("path"), F.lit("jar").alias("packaging"))).alias("modules"),
        F.transform("all", lambda x: F.struct(x["s_suppkey"].cast("string").alias("id"), x["s_name"].alias("name"), F.lit("1").alias("version"), F.concat(x["s_name"], F.lit(".jar")).alias("jar"))).alias("nodes"),
        F.transform("all", lambda x: F.struct(F.col("root").alias("src"), x["s_suppkey"].cast("string").alias("dst"), F.when(x["s_suppkey"] % 3 == 0, "test").otherwise("compile").alias("scope"))).alias("edges"),
        F.create_map(F.lit("compile"), F.transform(F.filter("all", lambda x: x["s_suppkey"] % 3 != 0), lambda x: x["s_name"])).alias("classpaths"),
    )
    path = _own(t, "models")
    one.select(F.to_json(model).alias("value")).write.text(path)
    return records.read_models(t.spark, path)


_ROOT = "'n' || s_nationkey || '-' || (s_suppkey // 1000)"


@query("S08_build_model_classpaths", f"SELECT {_ROOT} AS root, 'compile' AS scope, (row_number() OVER (PARTITION BY s_nationkey, s_suppkey // 1000 ORDER BY s_suppkey) - 1)::INT AS place, s_name AS id FROM supplier WHERE s_suppkey % 3 <> 0")
def _(t):
    return _models(t)["classpaths"]


@query("S08b_build_model_edges", f"SELECT {_ROOT} AS root, {_ROOT} AS src, s_suppkey::VARCHAR AS dst, CASE WHEN s_suppkey % 3 = 0 THEN 'test' ELSE 'compile' END AS scope, s_name || '.jar' AS jar FROM supplier")
def _(t):
    m = _models(t)
    return m["edges"].join(m["nodes"].select("root", F.col("id").alias("dst"), "jar"), ["root", "dst"]).select("root", "src", "dst", "scope", "jar")


# -- functions -----------------------------------------------------------------------------------------------------


@query(
    "P06b_symbol_identity",
    """SELECT p_partkey, 'maven g/' || replace(p_brand, '#', '') || ' ' || p_size || ' a/T' || p_partkey || '#In#' || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'run(int,java.lang.String[]).' WHEN 2 THEN '<init>(a.T.In).' ELSE 'field.' END AS scip FROM part""",
)
def _(t):
    fqn = F.concat(F.lit("a.T"), "p_partkey", F.lit("$In"))
    k = F.col("p_partkey") % 4
    rows = t.part.select("p_partkey", F.concat(F.lit("g:"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(":"), "p_size").alias("gav"), fqn.alias("fqn"), F.when(k == 0, fqn).otherwise("member").alias("key"), F.when(k == 1, "method").when(k == 2, "ctor").otherwise("field").alias("kind"), F.when(k == 1, "run").otherwise("field").alias("name"), F.when(k == 1, "(I[Ljava/lang/String;)V").when(k == 2, "(La/T$In;)V").alias("descriptor"))
    return rows.select("p_partkey", tx.symbol_identity("gav", "fqn", "key", "kind", "name", F.coalesce("descriptor", F.lit("()V"))).alias("scip"))


@query("P11b_type_substitution", "SELECT p_partkey, 'Map<' || p_type || ',List<? extends ' || p_type || '[]>> T1 ' || p_size AS display FROM part")
def _(t):
    return t.part.select("p_partkey", tx.substituted(F.lit("Map<T,List<? extends T[]>> T1 U"), F.array(F.lit("T"), F.lit("U")), F.array("p_type", F.col("p_size").cast("string"))).alias("display"))


@query(
    "X15_varint",
    """SELECT o_orderkey, CASE WHEN o_orderkey < 128 THEN printf('%02x', o_orderkey) WHEN o_orderkey < 16384 THEN printf('%02x%02x', (o_orderkey & 127) | 128, o_orderkey >> 7)
    ELSE printf('%02x%02x%02x', (o_orderkey & 127) | 128, ((o_orderkey >> 7) & 127) | 128, o_orderkey >> 14) END AS bytes, o_orderkey AS again FROM orders""",
)
def _(t):
    """Varints of keys of any size from 0 on; those of the SQL end at 2 ** 21, from where on its third byte runs over."""
    return t.orders.select("o_orderkey", tx.varint("o_orderkey").alias("bytes")).select("o_orderkey", "bytes", tx.varint_value("bytes").alias("again"))


@query("X16_text_edits", "SELECT p_partkey, 'X' || substr(p_name, 2, 1) || '--+' || substr(p_name, 3) || '!' AS text, NULL AS crossed FROM part")
def _(t):
    edit = lambda a, b, s: F.struct(F.lit(a).alias("start") if isinstance(a, int) else a.alias("start"), F.lit(b).alias("end") if isinstance(b, int) else b.alias("end"), F.lit(s).alias("new"))
    n = F.length("p_name")
    crossed = tx.edited("p_name", F.array(edit(0, 3, "a"), edit(2, 4, "b")))
    return t.part.select("p_partkey", tx.edited("p_name", F.array(edit(n, n, "!"), edit(2, 2, "--"), edit(0, 1, "X"), edit(2, 2, "+"))).alias("text"), crossed.alias("crossed"))


@query("X17_json_pointer_and_print", """SELECT event_id, regexp_extract(props, '[0-9]+') AS k, '{"a":["x",{"z":1}],"b":' || regexp_extract(props, '[0-9]+') || '}' AS printed, '1' AS inner_z FROM events""")
def _(t):
    whole = F.concat(F.lit('{ "b" : '), F.regexp_extract("props", "[0-9]+", 0), F.lit(', "a": ["x", {"z": 1}] }'))
    return t.events.select("event_id", tx.json_pointer("props", "/k").alias("k"), tx.json_canonical(whole).alias("printed"), tx.json_pointer(whole, "/a/1/z").alias("inner_z"))


@query(
    "X18_positions",
    r"""WITH x AS (SELECT p_partkey, p_name || chr(10) || p_brand || chr(10) || p_type AS text FROM part), y AS (SELECT *, p_partkey % (length(text) + 1) AS o FROM x), z AS (SELECT *, substr(text, 1, o::INT) AS before FROM y)
    SELECT p_partkey, (length(before) - length(replace(before, chr(10), '')))::INT AS line, length(list_last(string_split(before, chr(10))))::INT AS col, o::INT AS again FROM z""",
)
def _(t):
    x = t.part.select("p_partkey", F.concat_ws("\n", "p_name", "p_brand", "p_type").alias("text"))
    y = x.withColumn("o", (F.col("p_partkey") % (F.length("text") + 1)).cast("int")).withColumn("at", tx.line_and_column("text", "o"))
    return y.select("p_partkey", F.col("at.line").alias("line"), F.col("at.column").alias("col"), tx.offset_of("text", F.col("at.line"), F.col("at.column")).alias("again"))


@query("X19_typed_digest", "SELECT p_partkey, sha256('b' || length(p_partkey::VARCHAR) || ':' || p_partkey || 's' || length(p_partkey::VARCHAR) || ':' || p_partkey) AS d FROM part")
def _(t):
    return t.part.select("p_partkey", F.sha2(tx.typed("p_partkey", F.col("p_partkey").cast("string")), 256).alias("d"))


@query("U08b_diff_length", "SELECT conv_id, count(*) FILTER ((conv_id + turn) % 4 = 1) AS removed, 0 AS added FROM conversations GROUP BY conv_id HAVING count(*) FILTER ((conv_id + turn) % 4 = 1) > 0")
def _(t):
    """What is left of a sequence is part of it, so the shortest script has as many removals as rows went, and no additions."""
    a = t.conversations.select("conv_id", "turn", F.col("role").alias("item"))
    d = sets.ordered_diff(a, a.where("(conv_id + turn) % 4 <> 1"), "conv_id", "turn", "item")
    return d.groupBy("conv_id").agg(F.count_if(F.col("change") == "remove").alias("removed"), F.count_if(F.col("change") == "add").cast("int").alias("added"))


# -- scans and layers ----------------------------------------------------------------------------------------------


def _select(t, mode: str, q: str):
    facts = t.part.select("p_partkey", F.concat("p_name", F.lit(" "), "p_type").alias("name"))
    return s.overlay_select(facts, s.name_postings(facts, "name", "p_partkey"), mode, q, "name", "p_partkey", ["p_partkey"], 40, {"p_partkey": 5})


_PN = "SELECT p_partkey, p_name || ' ' || p_type AS name FROM part WHERE p_partkey > 5"


@query("S17b_overlay_exact", f"SELECT * FROM ({_PN}) WHERE lower(name) = 'blue bolt promo' ORDER BY p_partkey LIMIT 40")
def _(t):
    return _select(t, "exact", "Blue bolt PROMO")


@query("S17c_overlay_prefix", f"SELECT * FROM ({_PN}) WHERE starts_with(lower(name), 'blue b') ORDER BY p_partkey LIMIT 40")
def _(t):
    return _select(t, "prefix", "Blue B")


@query("S17d_overlay_substring", f"SELECT * FROM ({_PN}) WHERE contains(lower(name), 'lt pro') ORDER BY p_partkey LIMIT 40")
def _(t):
    return _select(t, "substring", "LT PRO")


@query("S18b_member_cursor", "SELECT p_brand, p_name, p_partkey FROM part WHERE p_brand = 'Brand#7' AND starts_with(p_name, 'b') AND (p_name > 'blue bolt' OR (p_name = 'blue bolt' AND p_partkey > 100)) ORDER BY p_name, p_partkey LIMIT 30")
def _(t):
    """A page after a cursor, of a generation that a later one doesn't change."""
    store = sink.Generations(t.spark, _own(t, "snapshots"))
    rows = t.part.select("p_brand", "p_name", "p_partkey")
    store.publish("one", rows)
    store.activate("one")
    snapshot = store.read("one")
    store.publish("two", rows.limit(0))
    store.activate("two")
    own = snapshot.where("p_brand = 'Brand#7'").where(F.col("p_name").startswith("b"))
    return s.page(own, ["p_name", "p_partkey"], 30, {"p_name": "blue bolt", "p_partkey": 100})


@query(
    "F14b_completion_members",
    """WITH m AS (SELECT p_partkey AS id, p_name AS name, CASE p_partkey % 4 WHEN 0 THEN 'ctor' WHEN 1 THEN 'field' WHEN 2 THEN 'method' ELSE 'class' END AS kind, p_size AS flags, CASE WHEN p_partkey % 3 = 0 THEN 'here' ELSE 'there' END AS package, p_partkey % 5 AS depth FROM part),
    a AS (SELECT * FROM m WHERE kind <> 'ctor' AND (flags & 2) = 0 AND ((flags & 5) <> 0 OR package = 'here') AND (kind = 'class' OR (flags & 8) <> 0))
    SELECT id, name, kind FROM a WHERE kind <> 'field' OR depth = (SELECT min(depth) FROM a b WHERE b.kind = 'field' AND b.name = a.name)""",
)
def _(t):
    kind = F.when(F.col("p_partkey") % 4 == 0, "ctor").when(F.col("p_partkey") % 4 == 1, "field").when(F.col("p_partkey") % 4 == 2, "method").otherwise("class")
    m = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), kind.alias("kind"), F.col("p_size").alias("flags"), F.when(F.col("p_partkey") % 3 == 0, "here").otherwise("there").alias("package"), (F.col("p_partkey") % 5).alias("depth"))
    return s.completion_members(m, "here", True).select("id", "name", "kind")


@query(
    "P10b_layer_trees",
    """SELECT 'T' AS tree, 'N' || n_nationkey AS key, n_nationkey::VARCHAR AS value FROM nation UNION ALL SELECT 'N', n_name, 'N' || n_nationkey FROM nation UNION ALL SELECT 'E', 'N' || n_nationkey, 'R' || n_regionkey FROM nation
    UNION ALL SELECT 'A', a, 'N' || n_nationkey FROM nation, (VALUES ('x'), ('y')) v(a) WHERE a = 'x' OR n_nationkey % 2 = 0 UNION ALL SELECT 'O', 'N' || s_nationkey, count(*) || ':' || sum(s_suppkey * 7919)::BIGINT FROM supplier GROUP BY s_nationkey""",
)
def _(t):
    n = t.nation.select(_named("N", "n_nationkey").alias("owner"), F.lit("type").alias("kind"), F.col("n_name").alias("name"), _named("R", "n_regionkey").alias("super"), F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("x"))).alias("annotations"), F.col("n_nationkey").cast("long").alias("digest"))
    m = t.supplier.select(_named("N", "s_nationkey").alias("owner"), F.lit("method").alias("kind"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("super"), F.lit(None).cast("array<string>").alias("annotations"), (F.col("s_suppkey") * 7919).alias("digest"))
    return s.layer_trees(n.unionByName(m))


@query("J12b_unbuilt_siblings", "SELECT s_suppkey, 'not built: ' || s_suppkey AS error FROM supplier WHERE s_suppkey % 7 = 0 AND s_suppkey % 3 <> 0 AND s_suppkey % 2 <> 0")
def _(t):
    own = t.supplier.select("s_suppkey")
    layer = lambda m, v: own.where(F.col("s_suppkey") % m == 0).withColumn("value", F.lit(v))
    return unbuilt(own, "s_suppkey", own.where("s_suppkey % 7 = 0"), layer(3, "session"), layer(2, "built"))


@query("K10b_edit_equals_rebuild", "SELECT 256 AS buckets, 256 AS same, count(*) FILTER (o_orderkey % 11 <> 0 OR o_orderkey % 7 = 0) AS n FROM orders")
def _(t):
    """The bucket identities of an edited table are those of one that is built anew from the same rows."""
    base = t.orders.select("o_orderkey", F.col("o_custkey").alias("v"))
    gone, new = base.where("o_orderkey % 11 = 0"), base.where("o_orderkey % 7 = 0").withColumn("v", F.col("v") + 1)
    edited = ag.merkle_buckets(apply_edits(base, gone, new, ["o_orderkey"]), "t", "o_orderkey", "v")
    whole = base.where("o_orderkey % 11 <> 0 or o_orderkey % 7 = 0").withColumn("v", F.col("v") + (F.col("o_orderkey") % 7 == 0).cast("int"))
    rebuilt = ag.merkle_buckets(whole, "t", "o_orderkey", "v").withColumnRenamed("sum", "other").withColumnRenamed("n", "m")
    both = edited.join(rebuilt, "bucket", "full")
    return both.agg(F.count("*").cast("int").alias("buckets"), F.count_if(F.col("sum") == F.col("other")).cast("int").alias("same"), F.sum("n").cast("long").alias("n"))


@query("F17_argument_validation", "SELECT * FROM (VALUES ('fits', true), ('missing', false), ('small', false), ('extra', false), ('enum', false), ('either', true), ('both', false), ('not', false)) v(\"case\", ok)")
def _(t):
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 1}, "b": {"type": "array", "items": {"enum": ["x", "y"]}}}}
    forms = {"oneOf": [{"required": ["p"]}, {"required": ["q"]}]}
    cases = [("fits", {"a": 1, "b": ["x"]}, schema), ("missing", {}, schema), ("small", {"a": 0}, schema), ("extra", {"a": 1, "c": 1}, schema), ("enum", {"a": 1, "b": ["z"]}, schema), ("either", {"p": 1}, forms), ("both", {"p": 1, "q": 1}, forms), ("not", 5, {"not": {"type": "integer"}})]
    return t.spark.createDataFrame([(name, ok(value, rule)) for name, value, rule in cases], "case string, ok boolean")


@query("L10_pages_and_reassembly", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 200")
def _(t):
    """A page of 200 rows, cut into pieces of 4 KB of JSON and put together again."""
    rows = [r.asDict() for r in s.page(t.part.select("p_partkey", "p_name"), ["p_partkey"], 200).collect()]
    return t.spark.createDataFrame([(r["p_partkey"], r["p_name"]) for r in reassemble(respond(rows, 4096))], "p_partkey long, p_name string")


# -- tools ---------------------------------------------------------------------------------------------------------


def _catalog(t) -> Catalog:
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    fqn = F.concat("p_type", F.lit("."), name)
    sym = t.part.select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("maven x "), "p_partkey").alias("scip"), F.concat(F.lit("k"), "p_partkey").alias("binary_key"), name.alias("name"), F.concat("p_type", F.lit("/"), name).alias("name_path"), F.lit(0).alias("owner_id"),
        F.when(F.col("p_size") % 2 == 0, "class").otherwise("method").alias("kind"), F.lit(1).alias("flags"), (F.col("p_partkey") % 10).alias("artifact_id"), F.concat(F.lit("About {@code "), "p_brand", F.lit("}.\n\nMore.")).alias("doc"), F.col("p_name").alias("text"), F.lit(0).alias("body_start"), F.lit(3).alias("body_end"), F.concat("p_brand", F.lit(".java")).alias("source_file"), fqn.alias("fqn"),
    )
    art = t.supplier.where("s_suppkey < 10").select(F.col("s_suppkey").alias("artifact_id"), F.concat(F.lit("g:a:"), "s_suppkey").alias("gav"), F.when(F.col("s_suppkey") % 2 == 0, "local").otherwise("jar").alias("kind"), F.lit("p").alias("path"))
    edges = t.part.select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + 1).alias("dst"), F.when(F.col("p_partkey") % 2 == 0, "calls").otherwise("extends").alias("kind"))
    deps = t.nation.select(_named("r", "n_regionkey").alias("src"), _named("n", "n_nationkey").alias("dst"), F.lit("compile").alias("scope"), _named("v", "n_nationkey").alias("winner"), F.lit(None).cast("string").alias("reason"))
    return Catalog(sym, art, edges, None, deps)


_SYM = "SELECT p_partkey AS id, p_type || '/' || replace(p_name, ' ', '_') AS name_path, p_partkey % 10 AS artifact_id, CASE WHEN p_size % 2 = 0 THEN 'class' ELSE 'method' END AS kind FROM part"


@query("tool_find", f"SELECT id, name_path, substr('x', 1, 0) || (SELECT substr(p_name, 1, 3) FROM part WHERE p_partkey = id) AS body FROM ({_SYM}) WHERE artifact_id % 2 = 0 AND name_path = 'PROMO/blue_bolt' AND kind = 'class' ORDER BY id LIMIT 20")
def _(t):
    return _catalog(t).find("PROMO/blue_bolt", kinds=["class"], include_body=True, limit=20).select("id", "name_path", "body")


@query("tool_find_identity", f"SELECT id, name_path FROM ({_SYM}) WHERE id = 42")
def _(t):
    return _catalog(t).find("maven x 42", scope="all").select("id", "name_path")


@query("tool_find_offset", f"SELECT id FROM ({_SYM}) WHERE artifact_id % 2 = 1 AND name_path LIKE '%blue%' ORDER BY id LIMIT 30 OFFSET 10")
def _(t):
    return _catalog(t).find("blue", scope="deps", substring=True, limit=30, cursor="10").select("id")


@query("tool_overview", "SELECT p_partkey AS id FROM part WHERE p_brand = 'Brand#7' ORDER BY p_type || '/' || replace(p_name, ' ', '_'), p_partkey LIMIT 100")
def _(t):
    return _catalog(t).overview(path="Brand#7.java", depth=2).select("id")


@query("tool_describe", "SELECT p_partkey AS id, 'About `' || p_brand || '`.' AS doc FROM part WHERE p_partkey IN (11, 12)")
def _(t):
    return _catalog(t).describe("k11", depth=5).select("id", "doc")


@query("tool_references", "SELECT p_partkey AS id, 1 AS level FROM part WHERE p_partkey = 20")
def _(t):
    return _catalog(t).references("k21", depth=4).select("id", "level")


@query("tool_hierarchy", "SELECT p_partkey AS id, 1 AS level FROM part WHERE p_partkey = 22")
def _(t):
    return _catalog(t).hierarchy("k21", depth=4).select("id", "level")


@query("tool_deps", "SELECT 'n' || n_nationkey AS id, 1 AS level, 'v' || n_nationkey AS winner FROM nation WHERE n_regionkey = 2")
def _(t):
    return _catalog(t).deps("r2").select("id", "level", "winner")


@query("tool_status", "SELECT 'artifacts' AS what, count(*) AS n FROM supplier WHERE s_suppkey < 10 UNION ALL SELECT 'symbols', count(*) FROM part UNION ALL SELECT 'edges', count(*) FROM part")
def _(t):
    return _catalog(t).status()
