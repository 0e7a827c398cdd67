import json

import pytest

from tessera.plans import tools
from tessera.sources.tables import Generations


@pytest.fixture(scope="module")
def catalog(spark):
    sym = [
        (1, "m a#T", "T", "T", "a.T", 0, "class", 1, 1, "First.\n\nMore {@code x}.", "class T { }", 0, 5, "T.java", "a.T"),
        (2, "m a#T.run", "T.run", "run", "a.T/run", 1, "method", 1, 1, None, "void run() {}", 5, 10, "T.java", "a.T.run"),
        (3, "m a#T.hide", "T.hide", "hide", "a.T/hide", 1, "method", 2, 1, None, "x", -1, -1, "T.java", "a.T.hide"),
        (4, "m b#U", "U", "U", "b.U", 0, "class", 1, 2, "U doc", "y", 0, 1, "U.java", "b.U"),
        (5, "m a#T", "T", "T", "a.T", 0, "class", 1, 2, "copy", "z", 0, 1, "T.java", "a.T"),
    ]
    cols = "id long, scip string, binary_key string, name string, name_path string, owner_id long, kind string, flags int, artifact_id long, doc string, text string, body_start int, body_end int, source_file string, fqn string"
    arts = spark.createDataFrame([(1, "g:a:1", "local", "p1"), (2, "g:b:1", "jar", "p2")], "artifact_id long, gav string, kind string, path string")
    edges = spark.createDataFrame([(4, 1, "extends"), (2, 4, "calls"), (1, 2, "contains")], "src long, dst long, kind string")
    members = spark.createDataFrame([(1, 1, 0), (1, 2, 1)], "workspace_id long, artifact_id long, pos long")
    deps = spark.createDataFrame([("p", "lib", "compile", "2", None), ("p", "mid", "compile", "1", None), ("mid", "lib", "test", "2", "conflict")], "src string, dst string, scope string, winner string, reason string")
    return tools.Catalog(spark.createDataFrame(sym, cols), arts, edges, members, deps)


def ids(df):
    return [r.id for r in df.collect()]


def test_find(catalog):
    assert ids(catalog.find("T", scope="all", workspace=1)) == [1]
    assert ids(catalog.find("T", depth=1, workspace=1)) == [1, 2, 3]
    assert ids(catalog.find("T", depth=1, kinds=["class"], workspace=1)) == [1]
    assert ids(catalog.find("u", scope="deps", substring=True, workspace=1)) == [4]
    page = catalog.find("a", scope="all", substring=True, limit=1, workspace=1).collect()
    assert [r.id for r in page] == [1] and page[0].truncated
    assert ids(catalog.find("a", scope="all", substring=True, limit=2, cursor="index:1", workspace=1)) == [2, 3]
    assert catalog.find("run", include_body=True, workspace=1).first().body == "run()"
    for bad in ({"limit": 0}, {"limit": 201}, {"cursor": "index:0"}, {"scope": "none"}, {"depth": 11}):
        with pytest.raises(tools.InvalidArgument):
            catalog.find("T", **bad)
    with pytest.raises(tools.InvalidArgument):
        catalog.find("a//b")


def test_other_tools(catalog):
    assert ids(catalog.overview(path="T.java", depth=1)) == [1, 5]
    with pytest.raises(tools.InvalidArgument):
        catalog.overview()
    assert [r.doc for r in catalog.describe("m b#U").collect()] == ["U doc"]
    assert "`x`" in catalog.describe("T", "full").first().doc and catalog.describe("T").first().doc == "First."
    assert ids(catalog.references("U")) == [2] and ids(catalog.hierarchy("U")) == [1] and ids(catalog.hierarchy("T", "down")) == [4]
    assert ids(catalog.deps("p")) == ["lib", "mid"]
    assert {r.what: r.n for r in catalog.status().collect()} == {"artifacts": 2, "symbols": 5, "edges": 3}


def test_schema_checks():
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 1}, "b": {"type": "array", "items": {"enum": ["x"]}}}}
    tools.check({"a": 1, "b": ["x"]}, schema)
    for bad in ({}, {"a": 0}, {"a": True}, {"a": 1, "c": 2}, {"a": 1, "b": ["y"]}):
        with pytest.raises(tools.InvalidArgument):
            tools.check(bad, schema)


def test_responses_fit_and_come_back():
    rows = [{"i": i, "t": "é" * (i * 37 % 900)} for i in range(60)]
    pages = tools.respond(rows, 1024)
    assert all(len(p.encode()) <= 1024 for p in pages) and tools.reassemble(pages) == rows
    assert json.loads(pages[0])


def test_generations(spark, tmp_path):
    g = Generations(spark, "file://" + str(tmp_path))
    assert g.publish("a", spark.range(3)) and not g.publish("a", spark.range(5)) and g.publish("b", spark.range(4))
    with pytest.raises(LookupError):
        g.read()
    g.activate("a")
    with pytest.raises(ValueError):
        g.activate("b", lambda df: df.count() > 10)
    assert g.read().count() == 3
    g.activate("b")
    g.activate("b")
    g.rollback()
    assert g.read().count() == 3 and g.pointer()["previous"] == "b"
