"""Traps and edge cases on small hand-made rows."""

import inspect
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions import fingerprint as fp
from tessera.functions import text as tx
from tessera.operators import aggregates, graph, layers, relations, search, sets, windows
from tessera.plans import ORACLES, QUERIES
from tessera.streaming import deltas


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


def test_substring_is_literal_and_folds_case(spark):
    d = spark.createDataFrame([(1, "a%b"), (2, "aXb"), (3, "A%B"), (4, None)], "id int, name string")
    assert ids(d.where(search.substring_match("a%b", "name"))) == [1, 3]


def test_limits_and_empty_kinds(spark):
    d = spark.createDataFrame([(i, "k") for i in range(5)], "id int, kind string")
    assert search.page(d, ["id"], 0).count() == 0 and search.page(d, ["id"], -3).count() == 0
    assert d.where(search.kind_in("kind", [])).count() == 5
    e = spark.createDataFrame([(0, 1, "k")], "src int, dst int, kind string")
    assert graph.closure(e, d.select("id"), 3, []).count() == 0


def test_pages_join_up(spark):
    d = spark.createDataFrame([(i % 3, i) for i in range(20)], "a int, b int")
    got, after = [], None
    while True:
        p = [r.asDict() for r in search.page(d, ["a", "b"], 6, after).collect()]
        if not p:
            break
        got, after = got + p, p[-1]
    assert got == [r.asDict() for r in d.orderBy("a", "b").collect()]


def test_name_paths(spark):
    d = spark.createDataFrame([(["acme.Outer", "run"], ["int", "java.lang.String"]), (["Other", "run"], [])], "seg array<string>, params array<string>")
    count = lambda p: d.where(tx.name_path_matches(p, "seg", "params")).count()
    assert count("Outer/run") == 1 and count("run") == 2 and count("run(int,String)") == 1 and count("run()") == 1 and count("uter/run") == 0
    for bad in ("", "a//b", "a(", "1a", "a(void)"):
        with pytest.raises(ValueError):
            tx.parse_name_path(bad)


def test_grams_of_short_and_wide_texts(spark):
    d = spark.createDataFrame([("",), ("ab",), ("a😀b",), ("aaaa",)], "s string")
    assert [r.g for r in d.select(tx.grams("s", 3).alias("g")).collect()] == [[], [], ["a😀b"], ["aaa"]]
    d = spark.createDataFrame([(None,), ("a\n😀b\r\né😀",), ("😀😀😀😀",), ("a\u0301\u2028\u0085\0x",)], "s string")
    brute = lambda s, n: {s[i : i + n] for i in range(len(s or "") - n + 1)}
    for n in (1, 2, 3, 5):
        for r in d.select("s", tx.grams("s", n).alias("g")).collect():
            assert set(r.g) == brute(r.s, n) and len(r.g) == len(set(r.g))


def test_grams_of_a_long_text_cost_in_proportion_to_it(spark):
    text = "".join(random.Random(5).choices("abcdeé😀 \n", k=60_000))
    d = spark.createDataFrame([(1, text)], "id int, s string")
    began = time.time()
    got = {r.gram for r in search.gram_postings(d, "id", "s").collect()}
    assert time.time() - began < 15
    assert got == {text[i : i + 3] for i in range(len(text) - 2)}


def test_fingerprints_are_order_free_and_add(spark):
    d = spark.range(100)
    one = d.agg(fp.fingerprint("x", "id").alias("v"))
    two = d.repartition(7).agg(fp.fingerprint("x", "id").alias("v"))
    assert one.first() == two.first()
    import hashlib

    total = sum(int(hashlib.sha256(f"x|{len(str(i))}:{i}".encode()).hexdigest(), 16) for i in range(100)) % 2**256
    assert d.select(fp.member("x", "id").alias("h")).agg(*fp.limbs("h")).select(fp.identity().alias("i")).first().i == f"{total:064x}"


def test_ordered_search_statuses(spark):
    e = spark.createDataFrame([("a", 0, True), ("b", 1, False), ("c", 2, True)], "artifact_id string, pos long, indexed boolean")
    dec = spark.createDataFrame([("X", "a"), ("X", "c"), ("Y", "c")], "name string, artifact_id string")
    q = spark.createDataFrame([("X",), ("Y",), ("Z",)], "name string")
    got = {r.name: (r.status, r.winner, r.searched) for r in layers.ordered_search(q, e, dec).collect()}
    assert got == {"X": ("FOUND", "a", 1), "Y": ("UNKNOWN", None, 3), "Z": ("UNKNOWN", None, 3)}
    sure = e.withColumn("indexed", F.lit(True))
    assert {r.name: r.status for r in layers.ordered_search(q, sure, dec).collect()} == {"X": "FOUND", "Y": "FOUND", "Z": "ABSENT"}


def test_masking(spark):
    up = spark.createDataFrame([("o1", "a"), ("o2", "a")], "owner string, key string")
    low = spark.createDataFrame([("o1", "b"), ("o2", "b"), ("o3", "c")], "owner string, key string")
    st = spark.createDataFrame([("o1", "COMPLETE"), ("o2", "PARTIAL")], "owner string, status string")
    none = st.limit(0)
    got = {(r.owner, r.key) for r in layers.masked_union([up, low], "owner", "key", [st, none]).collect()}
    assert got == {("o1", "a"), ("o2", "a"), ("o2", "b"), ("o3", "c")}


def test_longest_prefix_and_innermost(spark):
    rows = spark.createDataFrame([("/a/b/c",), ("/a",), ("/x",)], "path string")
    roots = spark.createDataFrame([("/a",), ("/a/b",)], "root string")
    assert {r.path: r.root for r in relations.longest_prefix(rows, roots, "path", "root").collect()} == {"/a/b/c": "/a/b", "/a": "/a", "/x": None}
    spans = spark.createDataFrame([(1, 0, 100), (2, 10, 20), (3, 12, 13)], "id long, a long, b long")
    pts = spark.createDataFrame([(12,), (15,), (20,), (100,)], "x long")
    assert {r.x: r.id for r in relations.innermost_interval(pts, spans, "x", "a", "b", "id", 8).collect()} == {12: 3, 15: 2, 20: 1}


def test_graph_against_plain_python(spark):
    rng = random.Random(5)
    n = 14
    edges = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(22)} | {(3, 3)})
    e = spark.createDataFrame(edges, "src int, dst int")
    nodes = spark.createDataFrame([(i,) for i in range(n)], "id int")
    out = {i: {b for a, b in edges if a == i} for i in range(n)}

    def closed(i):
        seen, todo = set(), list(out[i])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out[x]
        return seen

    reach = {i: closed(i) for i in range(n)}
    assert ids(graph.cycles(e)) == [i for i in range(n) if i in reach[i]]
    comp = {i: min([i, *[j for j in reach[i] if i in reach[j]]]) for i in range(n)}
    got = graph.components(e, nodes, spark.createDataFrame([(3,)], "id int")).collect()
    assert {r.id: r.comp for r in got} == comp
    assert {r.id: r.final for r in got} == {i: i != 3 and 3 not in reach[i] and all(3 not in reach[j] and j != 3 for j in range(n) if comp[j] == comp[i]) for i in range(n)}
    level = {r.id: r.level for r in graph.topological_levels(e, nodes).collect()}
    for i in range(n):
        bad = i in reach[i] or any(j in reach[j] for j in reach[i])
        assert (level[i] is None) == bad
        if not bad:
            assert level[i] == (1 + max(level[j] for j in out[i]) if out[i] else 0)


def test_graph_walks_have_no_depth_limit(spark):
    n = 66
    chain = spark.createDataFrame([(i + 1, i) for i in range(n)], "src int, dst int").coalesce(1)
    one = spark.createDataFrame([(0,)], "id int").coalesce(1)
    assert ids(graph.reverse_closure(chain, one)) == list(range(n + 1))
    assert "levels" not in inspect.signature(graph.topological_levels).parameters


def test_long_cycle(spark):
    ring = spark.createDataFrame([(i, (i + 1) % 140) for i in range(140)], "src int, dst int").coalesce(1)
    got = graph.components(ring, ring.select(F.col("src").alias("id"))).collect()
    assert len(got) == 140 and {r.comp for r in got} == {0}


def test_reverse_closure_skips_covered_but_not_roots(spark):
    e = spark.createDataFrame([(2, 1), (3, 2), (4, 1)], "src int, dst int")
    one = spark.createDataFrame([(1,)], "id int")
    assert ids(graph.reverse_closure(e, one)) == [1, 2, 3, 4]
    assert ids(graph.reverse_closure(e, one, spark.createDataFrame([(2,), (1,)], "id int"))) == [1, 4]


def test_diff_is_null_safe_and_edits_add_beats_remove(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "z"), (2, None), (4, "w")], "k int, v string")
    assert {r.k: r.change for r in relations.keyed_diff(a, b, ["k"], "v").collect()} == {1: "changed", 3: "removed", 4: "added"}
    got = layers.apply_edits(a, a.where("k <= 2"), b.where("k = 1"), ["k"])
    assert sorted((r.k, r.v) for r in got.collect()) == [(1, "z"), (3, "y")]


def test_myers_scripts():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(8))] for _ in range(2))
        s = sets.myers(a, b)
        keep = [(i, j) for c, i, j in s if c == "keep"]
        assert all(a[i] == b[j] for i, j in keep) and keep == sorted(keep)
        assert sorted([i for i, _ in keep] + [i for c, i, _ in s if c == "remove"]) == list(range(len(a)))
        assert sorted([j for _, j in keep] + [j for c, _, j in s if c == "add"]) == list(range(len(b)))


def test_occurrences_count_within_a_name_and_null_keys_last(spark, tmp_path):
    part = [(5, "a"), (None, "a"), (1, "a"), (5, "a"), (None, "a"), (2, None), (3, None), (7, ""), (6, ""), (9, "a#2")]
    spark.createDataFrame(part, "p_partkey long, p_name string").repartition(3).write.parquet(str(tmp_path / "part.parquet"))
    name = "W04_occurrence_numbering"
    got = sorted((str(r.p_partkey), str(r.slot)) for r in QUERIES[name](spark, str(tmp_path)).collect())
    c = duckdb.connect()
    c.sql(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    assert got == sorted((str(k), str(slot)) for k, slot in c.sql(ORACLES[name]).fetchall())
    assert ("1", "a") in got and ("None", "a#5") in got and ("7", "#2") in got and got.count(("9", "a#2")) == 1
    d = spark.createDataFrame([("b", 0), ("a", 1), ("c", 2)], "k string, pos int")
    assert sorted(tuple(r) for r in windows.numbered(d, ["k"], "n").select("k", "n").collect()) == [("a", 0), ("b", 1), ("c", 2)]


def test_unique_keys_are_enforced(spark):
    d = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(Exception, match="duplicate key"):
        windows.require_unique(d, "k").collect()


def test_empty_tables(spark):
    d = spark.createDataFrame([], "id int, name string, pos int")
    assert layers.first_winner(d, ["name"], "pos").count() == 0
    assert windows.islands(d, ["name"], "pos").count() == 0
    assert aggregates.conflict_report(d, "name", "id", "name").count() == 0
    assert graph.cycles(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_version_guard_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("a", 1, 10), ("a", 3, 30), ("b", 5, 50)], [("a", 2, 20), ("a", 4, 40), ("b", 5, 51)]
    spark.createDataFrame(rows[0], "k string, version long, v long").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("k string, version long, v long").parquet(src)
    out = deltas.version_guard(stream, "k", "version")
    q = out.writeStream.format("memory").queryName("guarded").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        spark.createDataFrame(rows[1], "k string, version long, v long").coalesce(1).write.mode("append").parquet(src)
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted((r.k, r.version) for r in spark.sql("select * from guarded").collect()) == [("a", 1), ("a", 3), ("a", 4), ("b", 5)]


def test_overrides_are_made_distinct_only_for_repeated_ids(spark):
    r = random.Random(7)
    cols = "id int, owner string, name string, params string, flags int, package string"
    ext = [("C", "B"), ("B", "A"), ("C", "A"), ("A", None)]
    up = {("C", "B"), ("C", "A"), ("B", "A")}
    row = lambda i: (i, r.choice("ABC"), r.choice("xy"), r.choice("pq"), r.choice([0, 1, 2, 4, 8]), r.choice("mn"))
    single, repeated = [row(i) for i in range(60)], [row(r.choice([None, *range(12)])) for _ in range(60)]
    for rows in (single, repeated, repeated + single[20:]):
        able = [x for x in rows if not x[4] & 10]
        want = {(c[0], p[0]) for c in able for p in able if (c[1], p[1]) in up and c[2:4] == p[2:4] and (p[4] & 5 or c[5] == p[5])}
        df = relations.overrides(spark.createDataFrame(rows, cols), spark.createDataFrame(ext, "child string, parent string"))
        got = [tuple(x) for x in df.collect()]
        assert len(got) == len(want) > 20 and set(got) == want
        if rows is single:  # nothing is held of the pairs, which are quadratic in the methods of one shape
            assert "Aggregate" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_islands_by_ranges(spark, monkeypatch):
    r = random.Random(3)
    rows = [(k, p) for k in ("a", "b", None) for p in r.choices(range(-20, 300), k=250)] + [("a", None), ("a", None), ("c", 5)]
    want = []
    for k in {k for k, _ in rows}:
        have = {p for q, p in rows if q == k and p is not None}
        want += [(k, p, next(e for e in range(p + 1, 400) if e not in have)) for p in have if p - 1 not in have]
    got = [tuple(x) for x in windows.islands(spark.createDataFrame(rows, "k string, p long"), ["k"], "p").collect()]
    assert sorted(got, key=str) == sorted([*want, ("a", None, None)], key=str)

    kept, cut = [], windows.cut
    monkeypatch.setattr(windows, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        one = spark.range(10_000).where("id % 100 != 7").select(F.lit("k").alias("k"), "id")
        assert windows.islands(one, ["k"], "id").count() == 101
        sizes = [x["count"] for x in kept[0].groupBy("__part").count().collect()]
    finally:
        spark.conf.unset(coalesce)
    assert sum(sizes) == 9_900 and max(sizes) < 5_000  # one key, but no task has it all


def test_class_files(spark, tmp_path):
    import os
    import shutil

    import pyspark

    from tessera.sources import classes

    jars = os.path.join(os.path.dirname(pyspark.__file__), "jars")
    jar = sorted(f for f in os.listdir(jars) if f.startswith("py4j"))[0]
    shutil.copy(os.path.join(jars, jar), tmp_path / jar)
    (tmp_path / "broken.jar").write_bytes(b"no archive")
    (tmp_path / "Bad.class").write_bytes(b"\xca\xfe\xba\xbe12")
    s = classes.read_symbols(spark, str(tmp_path)).cache()
    assert s.where("warning is not null").count() == 2
    assert s.where("name = 'GatewayServer' and kind = 'class'").count() == 1
    assert s.where("kind = 'constructor' and owner = 'py4j/GatewayServer'").count() > 1
    assert classes.signature_edges(s).where("target = 'java/lang/Object' and kind = 'extends'").count() > 10
    assert classes.code_edges(s).where("owner = 'py4j/GatewayServer' and kind = 'calls'").count() > 10
    assert classes.class_references(s).where("target like '[%'").count() == 0
