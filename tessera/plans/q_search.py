"""Scans, filters, projections and paging over the test tables.

Bindings: a symbol is a part (id p_partkey, name p_name, kind p_type, owner p_brand, flags p_size); an artifact is a
supplier; a document text is its documentation.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import search as s
from ..operators.layers import first_winner
from .registry import query

SYM = "SELECT p_partkey AS id, p_name AS name, p_type AS kind, p_brand AS owner, p_size AS flags FROM part"


def symbols(t):
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("owner"), F.col("p_size").alias("flags"))


def artifacts(t):
    return t.supplier.select(F.col("s_suppkey").alias("artifact_id"), F.concat(F.lit("g:a:"), F.col("s_suppkey")).alias("gav"), F.when(F.col("s_suppkey") % 7 == 0, "local").when(F.col("s_suppkey") % 7 == 1, "sources").otherwise("jar").alias("kind"), F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("jdk:"), "s_name")).otherwise(F.concat(F.lit("lib/"), "s_name")).alias("path"), "s_nationkey")


ART = "SELECT s_suppkey AS artifact_id, 'g:a:' || s_suppkey AS gav, CASE WHEN s_suppkey % 7 = 0 THEN 'local' WHEN s_suppkey % 7 = 1 THEN 'sources' ELSE 'jar' END AS kind, CASE WHEN s_suppkey % 5 = 0 THEN 'jdk:' || s_name ELSE 'lib/' || s_name END AS path, s_nationkey FROM supplier"


@query("find_keyset_page", f"SELECT id, name, kind FROM ({SYM}) WHERE contains(lower(name), 'bolt') AND kind IN ('ECONOMY', 'SMALL', 'PROMO') AND id > 100 ORDER BY id LIMIT 50")
def find_keyset_page(t):
    got = symbols(t).where(s.substring_match("BOLT", "name") & s.kind_in("kind", ["ECONOMY", "SMALL", "PROMO"]))
    return s.page(got.select("id", "name", "kind"), ["id"], 50, {"id": 100})


@query("S10_prefix_range_scan", "SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'red')")
def _(t):
    return s.prefix_scan(t.part, "p_name", "red").select("p_partkey", "p_name")


@query("S11_point_get", "SELECT p_partkey, p_name, p_type FROM part WHERE p_partkey = 77")
def _(t):
    return s.point_get(t.part.select("p_partkey", "p_name", "p_type"), "p_partkey", 77)


@query("S12_posting_scan", "SELECT gram, count(*)::BIGINT AS n FROM (SELECT DISTINCT p_partkey, substr(lower(p_name), i, 3) AS gram FROM part, unnest(range(1, length(p_name) - 1)) r(i)) GROUP BY gram")
def _(t):
    return s.gram_postings(t.part, "p_partkey", "p_name").groupBy("gram").agg(F.count("*").alias("n"))


@query("S13_artifact_selection", f"SELECT artifact_id, kind, path FROM ({ART}) WHERE s_nationkey < 5 OR starts_with(path, 'jdk:')")
def _(t):
    members = t.supplier.where("s_nationkey < 5").select(F.lit(1).alias("workspace_id"), F.col("s_suppkey").alias("artifact_id"), F.col("s_suppkey").alias("pos"))
    return s.selected_artifacts(artifacts(t), members, 1, True).orderBy("precedence").select("artifact_id", "kind", "path")


@query("S13b_all_but_sources", f"SELECT artifact_id, kind FROM ({ART}) WHERE kind <> 'sources'")
def _(t):
    return s.selected_artifacts(artifacts(t), None).orderBy("precedence").select("artifact_id", "kind")


@query("S14_ordered_seek", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 100")
def _(t):
    return s.page(t.orders.select("o_orderkey", "o_custkey"), ["o_orderkey"], 100, {"o_orderkey": 500})


@query("S15_half_open_range", "SELECT c_custkey, c_name FROM customer WHERE c_name >= 'Customer#000000100' AND c_name < 'Customer#000000200'")
def _(t):
    return s.range_scan(t.customer, "c_name", "Customer#000000100", "Customer#000000200").select("c_custkey", "c_name")


@query("S16_owner_members", "SELECT p_brand, p_name, p_partkey FROM part WHERE p_brand = 'Brand#4' AND starts_with(p_name, 'b') AND (p_name > 'blue bolt' OR (p_name = 'blue bolt' AND p_partkey > 10)) ORDER BY p_name, p_partkey LIMIT 20")
def _(t):
    own = t.part.where("p_brand = 'Brand#4'").where(F.col("p_name").startswith("b")).select("p_brand", "p_name", "p_partkey")
    return s.page(own, ["p_name", "p_partkey"], 20, {"p_name": "blue bolt", "p_partkey": 10})


@query("S17_overlay_select", "SELECT doc_id, lang FROM documents WHERE source = 'src3' AND contains(lower(text), 'the') AND doc_id > 5 ORDER BY doc_id LIMIT 40")
def _(t):
    return s.page(t.documents.where((F.col("source") == "src3") & s.substring_match("The", "text")).select("doc_id", "lang"), ["doc_id"], 40, {"doc_id": 5})


@query("S18_snapshot_cursor", "SELECT o_custkey, count(*)::BIGINT AS n FROM orders WHERE o_custkey BETWEEN 10 AND 60 GROUP BY o_custkey")
def _(t):
    snapshot = t.orders.select("o_custkey", "o_orderkey")
    return s.range_scan(snapshot, "o_custkey", 10, 61).groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("F01_kind_set", f"SELECT id, kind FROM ({SYM}) WHERE kind IN ('PROMO', 'LARGE')")
def _(t):
    return symbols(t).where(s.kind_in("kind", ["PROMO", "LARGE"])).select("id", "kind")


@query("F01b_empty_kind_set", f"SELECT count(*)::BIGINT AS n FROM ({SYM})")
def _(t):
    return symbols(t).where(s.kind_in("kind", [])).agg(F.count("*").alias("n"))


@query("F02_exact_identity", f"SELECT id, name, owner FROM ({SYM}) WHERE name = 'blue bolt' OR owner = 'blue bolt'")
def _(t):
    return symbols(t).where(s.exact_identity("blue bolt", "name", "owner")).select("id", "name", "owner")


@query("F03_name_path_match", f"SELECT id, owner, name FROM ({SYM}) WHERE replace(name, ' ', '_') = 'blue_bolt' AND owner = 'Brand#4'")
def _(t):
    have = symbols(t).withColumn("segments", F.array(F.concat(F.lit("acme."), F.translate("owner", "#", "_")), F.translate("name", " ", "_")))
    return have.where(tx.name_path_matches("Brand_4/blue_bolt", "segments")).select("id", "owner", "name")


@query("F03b_overload_match", "SELECT doc_id, lang FROM documents WHERE lang = 'en' AND source = 'src1'")
def _(t):
    d = t.documents.select("doc_id", "lang", F.array(F.lit("pkg.Doc"), "source").alias("seg"), F.array(F.concat(F.lit("java.lang."), "lang"), F.lit("int[]")).alias("params"))
    return d.where(tx.name_path_matches("Doc/src1(en,int[])", "seg", "params")).select("doc_id", "lang")


@query("F04_substring", f"SELECT id, name FROM ({SYM}) WHERE contains(lower(name), 'red w')")
def _(t):
    return symbols(t).where(s.substring_match("RED W", "name")).select("id", "name")


@query("F04b_gram_search", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'd bolt')")
def _(t):
    d = t.part.select("p_partkey", "p_name")
    return s.gram_search(d, s.gram_postings(d, "p_partkey", "p_name"), "p_partkey", "p_name", "D Bolt").select("p_partkey")


@query("F04c_gram_search_texts", "SELECT doc_id FROM documents WHERE contains(lower(text), 'token')")
def _(t):
    d = t.documents.select("doc_id", "text")
    return s.gram_search(d, s.gram_postings(d, "doc_id", "text"), "doc_id", "text", "Token").select("doc_id")


@query("F05_name_prefix", f"SELECT id, name FROM ({SYM}) WHERE starts_with(name, 'small')")
def _(t):
    return symbols(t).where(F.col("name").startswith("small")).select("id", "name")


@query("F06_search_visibility", f"SELECT id FROM ({SYM}) WHERE kind = 'ECONOMY' OR id % 3 = 0 OR (flags & 2) = 0")
def _(t):
    d = symbols(t).withColumn("local", F.when(F.col("kind") == "ECONOMY", "local").otherwise("jar")).withColumn("code", F.col("id") % 3 == 0)
    return d.where(s.visible("local", "code", "flags")).select("id")


@query("F07_depth", "SELECT page_id, url FROM pages WHERE starts_with(url, 'http://ththre.example.com/') AND length(url) - length(replace(url, '/', '')) - 2 <= 2")
def _(t):
    return t.pages.where(s.within_depth("url", "http://ththre.example.com", 2)).select("page_id", "url")


@query("F08_keyset_cursor", "SELECT c_custkey FROM customer WHERE c_custkey > 1000 ORDER BY c_custkey LIMIT 30")
def _(t):
    return s.page(t.customer.select("c_custkey"), ["c_custkey"], 30, {"c_custkey": 1000})


@query("F09_workspace_membership", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) OR s_suppkey % 5 = 0")
def _(t):
    nations = t.nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"), F.lit(True).alias("member"))
    return t.supplier.join(nations, "s_nationkey", "left").where(F.col("member") | (F.col("s_suppkey") % 5 == 0)).select("s_suppkey")


@query("F10_layer_filter", f"SELECT artifact_id FROM ({ART}) WHERE kind = 'local'")
def _(t):
    return artifacts(t).where(F.col("kind") == "local").select("artifact_id")


@query("F11_overlay_shadow", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return t.documents.join(t.labels.select("doc_id"), "doc_id", "left_anti").select("doc_id", "source")


@query("F12_accessibility", "SELECT p_partkey FROM part WHERE (p_size & 5) <> 0 OR ((p_size & 2) = 0 AND p_brand = 'Brand#4')")
def _(t):
    return t.part.where(s.accessible("p_size", F.concat("p_brand", F.lit(".C")), "Brand#4")).select("p_partkey")


@query("F13_override_eligibility", "SELECT p_partkey FROM part WHERE (p_size & 10) = 0")
def _(t):
    return t.part.where(F.col("p_size").bitwiseAND(10) == 0).select("p_partkey")


@query("F14_member_filters", "SELECT p_partkey, p_type FROM part WHERE p_type NOT IN ('PROMO', 'LARGE') AND ((p_size & 8) <> 0 OR p_type = 'STANDARD') AND (p_size & 2) = 0")
def _(t):
    static_receiver = (F.col("p_size").bitwiseAND(s.STATIC) != 0) | (F.col("p_type") == "STANDARD")
    return t.part.where(~F.col("p_type").isin("PROMO", "LARGE") & static_receiver & (F.col("p_size").bitwiseAND(s.PRIVATE) == 0)).select("p_partkey", "p_type")


@query("F15_unresolved_name_match", "SELECT p_partkey FROM part WHERE p_partkey % 100 = 0 OR p_name = 'blue bolt'")
def _(t):
    u = F.when(F.col("p_partkey") % 100 == 0, "*").otherwise(F.col("p_name"))
    name = "blue bolt"
    return t.part.where((u == "*") | (u == name) | F.lit(name).startswith(F.concat(u, F.lit("."))) | u.startswith(name + ".")).select("p_partkey")


@query("P01_doc_overlay", "SELECT d.doc_id, coalesce('quality ' || l.quality, d.lang) AS doc FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)")
def _(t):
    over = t.labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return t.documents.join(over, "doc_id", "left").select("doc_id", F.coalesce(F.concat(F.lit("quality "), "quality"), "lang").alias("doc"))


@query("P02_semantic_row", f"SELECT * FROM ({SYM})")
def _(t):
    return symbols(t)


@query("P03_context_columns", "SELECT l_orderkey, l_linenumber, l_suppkey, s_name AS path, s_nationkey AS kind FROM lineitem JOIN supplier ON s_suppkey = l_suppkey")
def _(t):
    ctx = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("path"), F.col("s_nationkey").alias("kind"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey").join(ctx, "l_suppkey").select("l_orderkey", "l_linenumber", "l_suppkey", "path", "kind")


@query("P04_narrow_projection", "SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part WHERE p_size > 40")
def _(t):
    return t.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size").where("p_size > 40")


@query("P05_typed_symbol", "SELECT p_partkey, p_brand || '/' || p_name AS path, p_size AS flags FROM part")
def _(t):
    typed = t.part.select(F.struct(F.col("p_partkey").alias("id"), F.concat_ws("/", "p_brand", "p_name").alias("path"), F.col("p_size").alias("flags")).alias("symbol"))
    return typed.select(F.col("symbol.id").alias("p_partkey"), F.col("symbol.path").alias("path"), F.col("symbol.flags").alias("flags"))


@query("P06_identity_construction", "SELECT p_partkey, 'maven ' || replace(p_brand, '#', '-') || ' ' || replace(p_name, ' ', '/') || '#' AS scip FROM part")
def _(t):
    scip = F.concat(F.lit("maven "), F.regexp_replace("p_brand", "#", "-"), F.lit(" "), F.array_join(F.split("p_name", " "), "/"), F.lit("#"))
    return t.part.select("p_partkey", scip.alias("scip"))


@query("P07_name_path_construction", "SELECT s_suppkey, 'NATION_' || s_nationkey || '/' || s_name AS name_path FROM supplier")
def _(t):
    return t.supplier.select("s_suppkey", F.concat_ws("/", F.concat(F.lit("NATION_"), "s_nationkey"), "s_name").alias("name_path"))


@query("P08_body_slice", "SELECT doc_id, substr(text, 11, 40) AS body FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.body_slice("text", F.lit(10), F.lit(50)).alias("body"))


@query("P09_doc_summary", "SELECT doc_id, split_part(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10), 1) AS summary FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.doc_summary(F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("summary"))


@query("P10_layer_trees", "SELECT tree, count(*)::BIGINT AS n FROM (SELECT CASE WHEN p_type = 'PROMO' THEN 'T' WHEN p_type = 'LARGE' THEN 'N' WHEN p_type = 'SMALL' THEN 'E' ELSE 'O' END AS tree FROM part) GROUP BY tree")
def _(t):
    tree = F.when(F.col("p_type") == "PROMO", "T").when(F.col("p_type") == "LARGE", "N").when(F.col("p_type") == "SMALL", "E").otherwise("O")
    return t.part.groupBy(tree.alias("tree")).agg(F.count("*").alias("n"))


@query("P11_type_substitution", "SELECT p_partkey, 'List<' || p_type || '> ' || p_name || '(' || p_brand || ')' AS display FROM part")
def _(t):
    template = F.lit("List<T> {name}(U)")
    shown = F.replace(F.replace(F.replace(template, F.lit("<T>"), F.concat(F.lit("<"), "p_type", F.lit(">"))), F.lit("(U)"), F.concat(F.lit("("), "p_brand", F.lit(")"))), F.lit("{name}"), F.col("p_name"))
    return t.part.select("p_partkey", shown.alias("display"))


@query("L01_bounded_top_k", "SELECT o_orderkey FROM orders WHERE o_orderkey > 42 ORDER BY o_orderkey LIMIT 25")
def _(t):
    return s.page(t.orders.select("o_orderkey"), ["o_orderkey"], 25, {"o_orderkey": 42})


@query("L02_ranked_top_k", "SELECT p_partkey, p_retailprice FROM part WHERE p_type = 'PROMO' ORDER BY p_retailprice DESC, p_partkey LIMIT 40")
def _(t):
    return t.part.where("p_type = 'PROMO'").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(40)


@query("L03_keyset_pages", "SELECT p_name, p_partkey FROM part ORDER BY p_name, p_partkey LIMIT 60")
def _(t):
    d = t.part.select("p_name", "p_partkey")
    first = s.page(d, ["p_name", "p_partkey"], 30)
    last = first.orderBy(F.desc("p_name"), F.desc("p_partkey")).first()
    return first.unionByName(s.page(d, ["p_name", "p_partkey"], 30, last.asDict()) if last else d.limit(0))


@query("L04_offset_cursor", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def _(t):
    return s.offset_page(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 40, 20)


@query("L05_look_ahead", "SELECT s_suppkey, (SELECT count(*) FROM supplier) > 15 AS truncated FROM supplier ORDER BY s_suppkey LIMIT 15")
def _(t):
    return s.page_with_more(t.supplier.select("s_suppkey"), ["s_suppkey"], 15)


@query("L06_external_sort", "SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id)::BIGINT AS pos FROM documents")
def _(t):
    from ..operators.windows import numbered, require_unique

    return numbered(require_unique(t.documents.select("doc_id", "n_chars"), "doc_id"), ["n_chars", "doc_id"], "pos0").select("doc_id", "n_chars", (F.col("pos0") + 1).alias("pos"))


@query("L07_ordered_merge", "SELECT name, id, layer FROM (SELECT p_name AS name, p_partkey AS id, 0 AS layer FROM part UNION ALL SELECT s_name, s_suppkey, 1 FROM supplier UNION ALL SELECT c_name, c_custkey, 2 FROM customer) ORDER BY name, id, layer LIMIT 100")
def _(t):
    a = t.part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("id"), F.lit(0).alias("layer"))
    b = t.supplier.select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"), F.lit(1).alias("layer"))
    c = t.customer.select(F.col("c_name").alias("name"), F.col("c_custkey").alias("id"), F.lit(2).alias("layer"))
    return a.unionByName(b).unionByName(c).orderBy("name", "id", "layer").limit(100)


@query("L08_completion_order", "SELECT p_partkey, p_name FROM part ORDER BY CASE p_type WHEN 'PROMO' THEN 0 WHEN 'SMALL' THEN 1 WHEN 'LARGE' THEN 2 ELSE 3 END, p_name, p_partkey LIMIT 50")
def _(t):
    from ..operators.relations import when_position

    return t.part.orderBy(when_position("p_type", ["PROMO", "SMALL", "LARGE"]), "p_name", "p_partkey").limit(50).select("p_partkey", "p_name")


@query("L11_edge_order", "SELECT DISTINCT l_suppkey AS src, l_partkey AS dst, l_returnflag AS kind FROM lineitem ORDER BY src, dst, kind LIMIT 200")
def _(t):
    return t.lineitem.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("kind")).distinct().orderBy("src", "dst", "kind").limit(200)


@query("L12_two_way_merge", "SELECT label, origin FROM (SELECT DISTINCT p_name AS label, 'lexical' AS origin FROM part UNION ALL SELECT s_name, 'hierarchy' FROM supplier) ORDER BY label, origin LIMIT 80")
def _(t):
    a = t.part.select(F.col("p_name").alias("label"), F.lit("lexical").alias("origin")).distinct()
    b = t.supplier.select(F.col("s_name").alias("label"), F.lit("hierarchy").alias("origin"))
    return a.unionByName(b).orderBy("label", "origin").limit(80)


@query("W02_first_per_identity", "SELECT p_name, min(p_partkey)::BIGINT AS id FROM part GROUP BY p_name")
def _(t):
    return first_winner(t.part.select("p_name", F.col("p_partkey").alias("id")), ["p_name"], "id").select("p_name", "id")
