"""Walks, sinks, sources and functions on small rows: traps, depth, ties and edge cases."""

import json
import time

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import graph, relations, sets, walks
from tessera.sources import java_source, records
from tessera.sources import tables as sink
from tessera.sources.class_writer import ClassWriter, archive
from tessera.sources.classes import ClassFile, code_edges, read_symbols
from tessera.streaming import deltas, live


def test_inherited_docs(spark):
    docs = [(1, "own"), (2, "{@inheritDoc} more"), (3, "a {@inheritDoc} b {@inheritDoc}"), (4, " "), (5, "{@inheritDoc}"), (6, "{@inheritDoc}"), (7, "x {@inheritDoc}"), (8, None)]
    parents = [(2, 4, 0), (2, 1, 1), (3, 2, 0), (5, 6, 0), (6, 5, 0), (7, 4, 0), (7, 8, 1)]
    got = walks.inherited_docs(spark.createDataFrame(docs, "id long, doc string"), spark.createDataFrame(parents, "id long, parent long, pos int"))
    assert {r.id: r.doc for r in got.collect()} == {1: "own", 2: "own more", 3: "a own more b own more", 4: " ", 5: "", 6: "", 7: "x ", 8: ""}


def test_receivers_take_the_first_way_and_unknown_owners_hide_all(spark):
    owners = spark.createDataFrame([("A", ["T"], True), ("B", ["T"], True), ("C", ["X", "Y"], True), ("D", [], False)], "owner string, variables array<string>, complete boolean")
    supers = spark.createDataFrame([("A", 0, "B", ["List<T>"]), ("A", 1, "C", ["T", "TT"]), ("B", 0, "C", ["T", "T[]"]), ("C", 0, "A", ["X"])], "owner string, pos int, parent string, arguments array<string>")
    roots = spark.createDataFrame([("r1", "A", ["Int"]), ("r2", "D", []), ("r3", "E", [])], "root string, owner string, arguments array<string>")
    got = {r.root: r.owners for r in walks.receiver_hierarchy(roots, supers, owners).collect()}
    assert got == {"r1": ["A<Int>", "B<List<Int>>", "C<Int,TT>"], "r2": None, "r3": None}


def test_dependency_conflict(spark):
    row = "src string, dst string, version string, scope string, pos int"
    e = spark.createDataFrame([("p", "lib", "2", "compile", 0), ("p", "mid", "1", "compile", 1), ("mid", "lib", "1", "compile", 0), ("mid", "p", "0", "compile", 1), ("lib", "deep", "1", "test", 0)], row)
    nodes, order = walks.dependency_walk(e, "p")
    assert sorted((r.name, r.version, r.winner, r.reason, r.level) for r in nodes.collect()) == [("deep", "1", True, None, 2), ("lib", "1", False, "conflict with 2", 2), ("lib", "2", True, None, 1), ("mid", "1", True, None, 1)]
    assert sorted((r.scope, r.place, r.name) for r in order.collect()) == [("compile", 0, "lib"), ("compile", 1, "mid"), ("test", 0, "deep")]
    assert walks.dependency_walk(e, "none")[0].count() == 0


def test_walks_go_to_the_end(spark):
    ring = spark.range(200).select(F.col("id").alias("src"), ((F.col("id") + 1) % 200).alias("dst"))
    assert graph.cycles(ring).count() == 200
    up = spark.range(25).select(F.col("id").alias("child"), (F.col("id") + 1).alias("parent"))
    members = spark.createDataFrame([(25, "m", 7, 1)], "owner long, name string, id long, flags int")
    got = relations.resolve_inherited(spark.createDataFrame([(1, 0, "m")], "src long, owner long, name string"), members, up).collect()
    assert [(r.found_in, r.levels) for r in got] == [(25, 25)]


@pytest.mark.parametrize("small", [2000, 0])
def test_strong_components_of_random_graphs(spark, monkeypatch, small):
    import random

    monkeypatch.setattr(graph, "SMALL", small)
    r = random.Random(5)
    rows = [(r.randrange(12), r.randrange(12)) for _ in range(20)] + [(100 + i, 100 + (i * 7 + 1) % 10) for i in range(10)] + [(200, 200), (None, 3)]
    e = spark.createDataFrame(rows, "src long, dst long")
    nodes = {x for row in rows for x in row if x is not None}
    to = {n: {b for a, b in rows if a == n and b is not None} for n in nodes}

    def reached(n):
        seen, open_ = set(), [n]
        while open_:
            for m in to[open_.pop()] - seen:
                seen.add(m)
                open_.append(m)
        return seen

    far = {n: reached(n) for n in nodes}
    assert {x.id for x in graph.cycles(e).collect()} == {n for n in nodes if n in far[n]}
    unknown = spark.createDataFrame([(7,)], "id long")
    got = {x.id: (x.comp, x.final) for x in graph.components(e, spark.createDataFrame([(n,) for n in nodes], "id long"), unknown).collect()}
    assert got == {n: (min([n, *(m for m in far[n] if n in far[m])]), 7 not in far[n] and n != 7) for n in nodes}


def test_repeated_points_and_long_spans(spark):
    pts = spark.createDataFrame([(5, "a"), (5, "a"), (5, "b"), (10**9 + 1, "c"), (7 * 10**9, "d")], "x long, y string")
    spans = spark.createDataFrame([(1, 0, 6 * 10**9), (2, 4, 6), (3, 10**9, 10**9 + 2), (4, 9, 9)], "id long, a long, b long")
    got = sorted((r.x, r.y, r.id) for r in relations.innermost_interval(pts, spans, "x", "a", "b", "id", 64).collect())
    assert got == [(5, "a", 2), (5, "a", 2), (5, "b", 2), (10**9 + 1, "c", 3)]


def test_shortest_scripts():
    import random

    r = random.Random(1)
    for _ in range(60):
        a, b = ([r.choice("abc") for _ in range(r.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        script = [c for c, *_ in sets.myers(a, b) if c != "keep"]
        assert len(script) == len(a) + len(b) - 2 * table[-1][-1]


def test_pointers_survive_a_break_and_refuse_a_second_writer(spark, tmp_path):
    store = sink.Generations(spark, "file://" + str(tmp_path / "g"))
    for k in "abc":
        store.publish(k, spark.range(3))
        store.activate(k)
    assert store.pointer() == {"active": "c", "previous": "b"} and len(list((tmp_path / "g" / "_pointers").glob("0*.json"))) <= 2
    (tmp_path / "g" / "_pointers" / "draft-broken").write_text("{")
    assert store.pointer()["active"] == "c"
    other = sink.Generations(spark, "file://" + str(tmp_path / "g"))
    known = other._pointers()
    store.rollback()
    other._pointers = lambda: known
    with pytest.raises(RuntimeError):
        other._point({"active": "x"})
    assert store.pointer() == {"active": "b", "previous": "c"}


def test_a_file_that_becomes_empty_loses_its_rows(spark, tmp_path):
    path = "file://" + str(tmp_path / "t")
    rows = spark.createDataFrame([("a=1", 1), ("b", 2), ("c", 3)], "file string, v int")
    sink.replace_partitions(rows, path, "file")
    sink.replace_partitions(rows.where("v = 2").withColumn("v", F.lit(9)), path, "file", owners=spark.createDataFrame([("a=1",), ("b",)], "file string"))
    assert sorted((r.file, r.v) for r in spark.read.parquet(path).select("file", "v").collect()) == [("b", 9), ("c", 3)]


def test_code_edges_of_written_classes(spark, tmp_path):
    w = ClassWriter("p/A", flags=0x21, signature="<T:Ljava/lang/Object;>Ljava/lang/Object;")
    w.add_field("f", "I")
    lookup = bytes([3]) + bytes([171]) + bytes(2) + (27).to_bytes(4, "big") + (2).to_bytes(4, "big") + bytes(16)
    wide = bytes([196, 132, 0, 1, 0, 5, 196, 21, 0, 1, 87])
    use = lambda op, i, more=b"": bytes([op]) + i.to_bytes(2, "big") + more
    code = lookup + wide + use(179, w.field("p/B", "x", "I")) + use(193, w.type("[[Lp/C;")) + use(193, w.type("[I")) + use(192, w.type("p/A")) + use(185, w.method("p/I", "go", "()V"), b"\1\0") + bytes([177])
    w.add_method("m", "(I)V", code, parameters=("count",))
    w.add_method("abstract", "()V", None, 0x401)
    c = ClassFile(w.bytes())
    assert c.edges() == [("p/A#m(I)V", "calls", "p/I#go()V"), ("p/A#m(I)V", "reads", "p/C"), ("p/A#m(I)V", "writes", "p/B#x")]
    assert c.parameters(c.methods[0]) == ["count"] and c.signature(c.attributes).startswith("<T:")
    (tmp_path / "x.jar").write_bytes(archive({"p/A.class": w.bytes(), "p/Cut.class": w.bytes()[:60], "module-info.class": b""}))
    s = read_symbols(spark, str(tmp_path))
    assert code_edges(s).count() == 3 and s.where("warning is not null").count() == 2
    assert read_symbols(spark, str(tmp_path), only="p/A").where("warning is not null").count() == 0


def test_java_sources(spark):
    text = '''package a.b;
import java.util.*; import static x.Y.z; import c.D;
/* class No { */ // class Neither {
@Ann(x = "class Not {") public abstract class Top<T extends D> implements Runnable {
  int field = call(1, 2);
  String s = """
     class Text { }
  """;
  /** Doc of make. */
  @Deprecated
  static <R> Map<String, R> make(@Ann final Map<String, List<R>> m, D[] ds, char c) throws java.io.IOException { if (c == '{') { run(); } return null; }
  Top(T t) { super(); new Object() { public void anonymous() { } }; }
  abstract void none();
  enum Kind { A, B; void of(int x) { } }
  record Pair(int a, int b) { Pair { } }
  @interface Mark { String value() default "}"; }
}
interface Other { default void hi(Top.Kind k) { } }
'''
    package, imports, rows = java_source.parse_source(text)
    assert package == "a.b" and imports == ["java.util.*", "static x.Y.z", "c.D"]
    types = [(r[0], r[1]) for r in rows if r[3] is None]
    assert types == [("a/b/Top", "class"), ("a/b/Top$Kind", "enum"), ("a/b/Top$Pair", "record"), ("a/b/Top$Mark", "annotation"), ("a/b/Other", "interface")]
    methods = {(r[0].split("/")[-1], r[2]): (r[3], r[4], r[6]) for r in rows if r[3] is not None}
    assert next(r[5] for r in rows if r[2] == "make") == ["T", "R"]
    assert methods["Top", "make"] == (["m", "ds", "c"], ["Map", "D[]", "char"], "Doc of make.")
    assert methods["Top", "<init>"] == (["t"], ["T"], None) and methods["Top$Kind", "of"][1] == ["int"] and methods["Other", "hi"][1] == ["Top.Kind"]
    assert ("Top", "run") not in methods and ("Top", "call") not in methods and ("Top", "none") in methods
    sources = spark.createDataFrame([("p", "e", package, imports, *r) for r in rows], java_source.SCHEMA)
    sym = [("a/b/Top", "method", "make", "(Ljava/util/Map;[Lc/D;C)Ljava/util/Map;"), ("a/b/Top", "method", "make", "(Ljava/util/Map;[Le/D;C)V"), ("a/b/Top", "constructor", "<init>", "(Lc/D;)V"), ("a/b/Top", "method", "none", "()V"), ("a/b/Top", "method", "none", "(I)V")]
    matched, unmatched = java_source.join_sources(spark.createDataFrame(sym, "owner string, kind string, name string, descriptor string"), sources)
    assert sorted((r.name, r.descriptor) for r in matched.collect()) == [("<init>", "(Lc/D;)V"), ("make", "(Ljava/util/Map;[Lc/D;C)Ljava/util/Map;"), ("none", "()V")]
    assert sorted((r.name, r.matches) for r in unmatched.collect()) == [("make", 0), ("none", 0)]


RULES = [
    ("{@code a < b}", "`a < b`"),
    ("{@literal <x>}", "<x>"),
    ("{@link List#add} {@linkplain Map}", "`List#add` `Map`"),
    ("one<p>two</p>three", "one\n\ntwo\n\nthree"),
    ("a<br>b<br/>c", "a\nb\nc"),
    ("<pre>x</pre> <code>y</code>", "`x` `y`"),
    ("<ul><li>a</li><li>b</li></ul>", "- a\n- b"),
    ("<b>x</b> <strong>y</strong>", "**x** **y**"),
    ("<i>x</i> <em>y</em>", "*x* *y*"),
    ("t\n@param n how many", "t\n\n- **n:** how many"),
    ("t\n@return what", "t\n\n**Returns:** what"),
    ("t\n@throws E when\n@exception F if", "t\n\n**Throws `E`:** when\n\n**Throws `F`:** if"),
    ("t\n@see U", "t\n\n**See:** U"),
    ("&lt;T&gt; &amp; &quot;q&quot;", '<T> & "q"'),
    ("  a\n\n\n\nb  ", "a\n\nb"),
]


def test_documentation_rules(spark):
    d = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(RULES)], "i int, a string")
    got = [r.x for r in d.orderBy("i").select(tx.doc_markdown("a").alias("x")).collect()]
    assert got == [b for _, b in RULES]


def test_functions_at_their_edges(spark):
    one = spark.range(1)
    value = lambda *c: tuple(one.select(*[x.alias(str(i)) for i, x in enumerate(c)]).first())
    n = [0, 1, 127, 128, 300, 2**31, 2**62 + 5]
    assert value(*[tx.varint_value(tx.varint(F.lit(x))) for x in n]) == tuple(n) and value(tx.varint(F.lit(300))) == ("ac02",)
    edges = [m for k in range(7, 64, 7) for m in (2**k - 1, 2**k, 2**k + 1) if m < 2**63]
    for m, b in zip(edges, value(*[tx.varint(F.lit(m)) for m in edges])):
        groups = [m >> s & 127 for s in range(0, m.bit_length(), 7)]
        assert bytes.fromhex(b) == bytes(x | 128 for x in groups[:-1]) + bytes(groups[-1:])
    assert value(tx.varint(F.lit(-1)), tx.varint(F.lit(None).cast("long"))) == (None, None)
    assert value(tx.offset_of(F.lit("ab\n\nc"), F.lit(2), F.lit(1)), tx.offset_of(F.lit("ab\n\nc"), F.lit(1), F.lit(1)), tx.offset_of(F.lit("ab"), F.lit(3), F.lit(0)), tx.offset_of(F.lit("é😀x"), F.lit(0), F.lit(2))) == (5, None, None, 2)
    assert value(tx.json_canonical(F.lit('{"b": [1, {"z":1,"a":2}], "a": null}')), tx.json_canonical(F.lit("{x"))) == ('{"a":null,"b":[1,{"a":2,"z":1}]}', None)
    assert value(tx.json_pointer(F.lit('{"a/b":{"c~d":[5]}}'), "/a~1b/c~0d/0")) == ("5",)
    assert value(tx.substituted(F.lit("T<TT,T[]> a.T"), F.array(F.lit("T")), F.array(F.lit("TT")))) == ("TT<TT,TT[]> a.T",)
    assert value(tx.with_names(F.lit("f(int a, int ab)"), F.array(F.lit("a"), F.lit("ab")), F.array(F.lit("x"), F.lit("y")), F.lit(False))) == ("f(int x, int y)",)
    assert value(F.sha2(tx.typed(F.lit(1)), 256) == F.sha2(tx.typed(F.lit("1")), 256)) == (False,)
    for bad in ("a//b", "1a", "a(int", "a(void)", "a(int[]x)", "", "²a"):
        with pytest.raises(ValueError):
            tx.parse_name_path(bad)
    assert tx.parse_name_path("$a/b$1(int[][],java.util.List)") == [("$a", None), ("b$1", ["int[][]", "java.util.List"])]


def test_streams(spark, tmp_path):
    rows = [(k, v, f"2024-01-01 0{v}:00:00") for k in "ab" for v in (1, 3, 2)]
    spark.createDataFrame(rows, "k string, v long, ts string").coalesce(1).write.json(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("k string, v long, ts timestamp").json(str(tmp_path / "in"))
    deltas.latest_by_batch(stream(), str(tmp_path / "out"), str(tmp_path / "c1"), ["k"], "v").awaitTermination(60)
    assert sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 3), ("b", 3)]
    q = deltas.windowed_counts(stream(), "ts", "k").writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.n for r in spark.table("w").collect()} == {1} and spark.table("w").count() == 6
    q = live.debounced_stream(stream(), "k", "ts", "3 hours").writeStream.format("memory").queryName("s").outputMode("complete").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.k, r.n) for r in spark.table("s").collect()} == {("a", 3), ("b", 3)}
    seen = []
    q = live.rescans(spark, seen.append, "file://" + str(tmp_path / "c4"), "1 seconds")
    end = time.time() + 60
    while len(seen) < 2 and time.time() < end:
        time.sleep(0.2)
    q.stop()
    assert seen[:2] == [0, 1]


def test_debounce_and_queue(spark):
    e = spark.createDataFrame([("a", t) for t in (0, 100, 250, 900, 1000, 1150, 1300)] + [("b", 5)], "k string, t long")
    got = sorted((r.k, r["first"], r["last"], r.n) for r in live.debounced(e, "k", "t", 200, 300).collect())
    assert got == [("a", 0, 250, 3), ("a", 900, 1150, 3), ("a", 1300, 1300, 1), ("b", 5, 5, 1)]
    d = spark.createDataFrame([("x", 1, "h1", 5), ("x", 2, "h2", 5), ("y", 3, "same", 5), ("z", 4, "h", 5), ("w", 5, "h", 5)], "k string, v long, h string, n int")
    state = spark.createDataFrame([("y", "same"), ("z", "old")], "k string, h string")
    assert sorted(r.k for r in live.publish_queue(d, state, ["k"], "v", "h", "n", 10).collect()) == ["w", "z"]
    assert sorted((r.k, r.v) for r in deltas.changed_only(d.where("v > 1"), state, ["k"], "h").collect()) == [("w", 5), ("x", 2), ("z", 4)]


def test_models_and_memos(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"root": "r", "modules": [], "nodes": [{"id": "a"}], "edges": [], "classpaths": {"test": ["a", "b"]}}) + "\n" + json.dumps({"root": "empty"}) + "\n")
    m = records.read_models(spark, str(tmp_path))
    assert m["nodes"].count() == 1 and m["edges"].count() == 0 and [(r.place, r.id) for r in m["classpaths"].orderBy("place").collect()] == [(0, "a"), (1, "b")]
    memos = spark.createDataFrame([(1, "i", "r1"), (2, "j", "r2")], "k int, i string, result string")
    want = spark.createDataFrame([(1, "i"), (2, "x"), (3, "i"), (1, None)], "k int, i string")
    assert sorted((r.k, r.reason) for r in records.look_up(memos, want, "k", "i").collect()) == [(1, "HIT"), (1, "UNKNOWN"), (2, "CHANGED"), (3, "MISS")]
