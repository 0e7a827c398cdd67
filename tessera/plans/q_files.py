"""Scans of class files, over archives that are written from the rows of ``supplier`` into the shared folder first.

Every supplier is a class ``n<nation>/S<key>``, every thousand suppliers of a nation are an archive. A tenth of the archives'
entries is damaged, a fifth of the classes has a newer version for later releases.
"""

from __future__ import annotations

import struct
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import functions as F

from ..functions import text as tx
from ..iterate import shared_dir
from ..sources import classes, java_source
from ..sources import tables as sink
from ..sources.class_writer import ClassWriter, archive
from .registry import query

#: Suppliers in an archive.
GROUP = 1000


def _op(code: int, operand: int | None = None, more: bytes = b"") -> bytes:
    return bytes([code]) + (b"" if operand is None else struct.pack(">H", operand)) + more


def supplier_class(nation: int, key: int, newer: bool = False) -> bytes:
    """A class with a field, a constructor, a static initialiser, a bridge and one method that uses what code can use."""
    base, helper, own = f"n{nation}/Base", f"n{nation}/Helper", f"n{nation}/S{key}"
    w = ClassWriter(own, base, ("java/lang/Runnable",) if key % 2 == 0 else ())
    w.add_field("total", "J", 2)
    if newer:
        w.add_field("newer", "I", 1)
    aload, pop, back = _op(42), _op(87), _op(177)
    w.add_method("<clinit>", "()V", _op(classes.NEW, w.type(helper)) + pop + back, 8)
    w.add_method("<init>", "()V", aload + _op(183, w.method(base, "<init>", "()V")) + back)
    run = aload + _op(classes.GETFIELD, w.field(own, "total", "J")) + _op(88) + aload + _op(27) + _op(classes.INVOKEVIRTUAL, w.method(base, "step", "(I)V"))
    run += _op(classes.GETSTATIC, w.field(base, "limit", "I")) + pop
    if key % 3 == 0:
        run += _op(3) + _op(classes.PUTSTATIC, w.field(base, "limit", "I"))
    run += aload + _op(classes.CHECKCAST, w.type(f"[L{helper};")) + pop
    if key % 7 == 0:
        factory = w.handle(6, w.method("java/lang/invoke/LambdaMetafactory", "metafactory", "()V"))
        run += _op(classes.INVOKEDYNAMIC, w.dynamic(factory, (w.handle(6, w.method(helper, "apply", "()V")), w.handle(2, w.field(helper, "flag", "Z"))), "get", "()V"), b"\0\0")
    # a switch, whose operands are aligned, before the last use
    run += _op(27)
    pad = bytes(3 - len(run) % 4)
    run += _op(classes.TABLESWITCH, None, pad + struct.pack(">iiiii", len(pad) + 21, 0, 1, len(pad) + 21, len(pad) + 21))
    run += _op(184, w.method(helper, "last", "()V")) + back
    w.add_method("run", "(I)V", run, 1, ("amount",))
    w.add_method("bridge", "()V", _op(184, w.method(helper, "bridged", "()V")) + back, 0x1041)
    return w.bytes()


def _archive(nation: int, keys: list[int]) -> bytes:
    entries = {}
    for key in keys:
        entries[f"n{nation}/S{key}.class"] = supplier_class(nation, key)
        if key % 5 == 0:
            entries[f"META-INF/versions/9/n{nation}/S{key}.class"] = supplier_class(nation, key, True)
            entries[f"META-INF/versions/99/n{nation}/S{key}.class"] = b"of a later release"
        if key % 10 == 0:
            entries[f"n{nation}/Bad{key}.class"] = b"\xca\xfe\xba\xbe12"
    return archive(entries)


SOURCE = """package n{nation};

import java.util.List;

/** Supplier {key}. */
public class S{key} extends Base implements Runnable {{
    private long total; // a brace {{ in a comment

    /** Runs with {{@code amount}}. */
    public void run(final int amount) throws Exception {{
        String s = "}}{{";
        if (amount > 0) {{ helper(amount); }}
    }}

    /* class Hidden {{ */
    static class Inner {{
        void in(List<String> xs, int... more) {{ }}
    }}
}}
"""


def _sources(nation: int, keys: list[int]) -> bytes:
    return archive({f"n{nation}/S{key}.java": SOURCE.format(nation=nation, key=key).encode() for key in keys})


def _repository(t) -> str:
    """A new folder in the shared one with the archives; written where the rows are."""
    root = f"{shared_dir(t.spark).rstrip('/')}/repository-{uuid.uuid4().hex}"

    def write(key: tuple[pa.Scalar, ...], batch: pa.Table) -> pa.Table:
        nation, group = (k.as_py() for k in key)
        where, folder = fs.FileSystem.from_uri(root)
        where.create_dir(folder, recursive=True)
        stem = f"n{nation}-{group}"
        for name, data in ((f"{stem}.jar", _archive(nation, batch["s_suppkey"].to_pylist())), (f"{stem}-sources.jar", _sources(nation, batch["s_suppkey"].to_pylist())), (f"{stem}-javadoc.jar", archive({}))):
            with where.open_output_stream(f"{folder}/{name}") as out:
                out.write(data)
        return pa.table({"name": [stem]})

    rows = t.supplier.select("s_nationkey", "s_suppkey", F.floor(F.col("s_suppkey") / GROUP).alias("g"))
    rows.groupBy("s_nationkey", "g").applyInArrow(write, "name string").count()
    return root


def _symbols(t, only: str | None = None):
    return classes.read_symbols(t.spark, _repository(t), glob="n*[0-9].jar", only=only)


OWNER = "'n' || s_nationkey || '/S' || s_suppkey"
BASE, HELPER = "'n' || s_nationkey || '/Base'", "'n' || s_nationkey || '/Helper'"
RUN = f"{OWNER} || '#run(I)V'"


@query(
    "S01_binary_skeleton_scan",
    """SELECT 'class' AS kind, count(*) AS n, 0 AS warnings FROM supplier UNION ALL SELECT 'constructor', count(*), 0 FROM supplier UNION ALL SELECT 'method', count(*), 0 FROM supplier
    UNION ALL SELECT 'field', count(*) + count(*) FILTER (s_suppkey % 5 = 0), 0 FROM supplier UNION ALL SELECT NULL, count(*), count(*) FROM supplier WHERE s_suppkey % 10 = 0""",
)
def _(t):
    return _symbols(t).groupBy("kind").agg(F.count("*").alias("n"), F.count("warning").alias("warnings"))


@query(
    "S02_module_class_scan",
    f"""WITH one AS (SELECT * FROM supplier WHERE s_suppkey = 7)
    SELECT {OWNER} AS owner, k.kind, k.name, k.descriptor, k.flags, k.parameters FROM one, (VALUES ('class', NULL, NULL, 33, NULL), ('field', 'total', 'J', 2, NULL), ('constructor', '<init>', '()V', 1, NULL), ('method', 'run', '(I)V', 1, 'amount')) k(kind, name, descriptor, flags, parameters)
    WHERE k.kind <> 'class' UNION ALL SELECT {OWNER}, 'class', 'S7', NULL, 33, NULL FROM one""",
)
def _(t):
    """One class looked up by its name: other entries aren't parsed."""
    one = t.supplier.where("s_suppkey = 7").select(F.concat(F.lit("n"), "s_nationkey", F.lit("/S7")).alias("x")).first()
    return _symbols(t, only=one.x).select("owner", "kind", "name", "descriptor", "flags", F.array_join("parameters", ",").alias("parameters"))


@query(
    "S03_code_scan",
    f"""SELECT {OWNER} AS owner, {OWNER} || '#<init>()V' AS src, 'calls' AS kind, {BASE} || '#<init>()V' AS target FROM supplier
    UNION ALL SELECT {OWNER}, {OWNER}, 'instantiates', {HELPER} FROM supplier
    UNION ALL SELECT {OWNER}, {RUN}, 'calls', {BASE} || '#step(I)V' FROM supplier
    UNION ALL SELECT {OWNER}, {RUN}, 'reads', {BASE} || '#limit' FROM supplier
    UNION ALL SELECT {OWNER}, {RUN}, 'writes', {BASE} || '#limit' FROM supplier WHERE s_suppkey % 3 = 0
    UNION ALL SELECT {OWNER}, {RUN}, 'reads', {HELPER} FROM supplier
    UNION ALL SELECT {OWNER}, {RUN}, 'calls', {HELPER} || '#last()V' FROM supplier
    UNION ALL SELECT {OWNER}, {RUN}, 'calls', 'java/lang/invoke/LambdaMetafactory#metafactory()V' FROM supplier WHERE s_suppkey % 7 = 0
    UNION ALL SELECT {OWNER}, {RUN}, 'calls', {HELPER} || '#apply()V' FROM supplier WHERE s_suppkey % 7 = 0
    UNION ALL SELECT {OWNER}, {RUN}, 'reads', {HELPER} || '#flag' FROM supplier WHERE s_suppkey % 7 = 0""",
)
def _(t):
    return classes.code_edges(_symbols(t))


@query(
    "S04_class_reference_scan",
    f"""WITH jars AS (SELECT *, s_suppkey // {GROUP} AS g FROM supplier),
    refs AS (SELECT DISTINCT s_nationkey, g, {OWNER} AS target FROM jars UNION SELECT s_nationkey, g, {BASE} FROM jars UNION SELECT s_nationkey, g, {HELPER} FROM jars
      UNION SELECT s_nationkey, g, 'java/lang/Runnable' FROM jars WHERE s_suppkey % 2 = 0 UNION SELECT s_nationkey, g, 'java/lang/invoke/LambdaMetafactory' FROM jars WHERE s_suppkey % 7 = 0)
    SELECT target, count(*) AS n FROM refs GROUP BY target""",
)
def _(t):
    return classes.class_references(_symbols(t)).groupBy("target").agg(F.count("*").alias("n"))


@query(
    "S06_repository_discovery",
    f"""WITH jars AS (SELECT DISTINCT 'n' || s_nationkey || '-' || (s_suppkey // {GROUP}) AS stem FROM supplier)
    SELECT stem || '.jar' AS file, 'binary' AS role FROM jars UNION ALL SELECT stem || '-sources.jar', 'sources' FROM jars""",
)
def _(t):
    return classes.discover(t.spark, _repository(t)).select(F.substring_index("path", "/", -1).alias("file"), "role")


@query(
    "S07_archive_entries",
    f"""WITH e AS (SELECT s_nationkey, s_suppkey // {GROUP} AS g, 'n' || s_nationkey || '/S' || s_suppkey || '.class' AS entry FROM supplier
      UNION ALL SELECT s_nationkey, s_suppkey // {GROUP}, 'n' || s_nationkey || '/Bad' || s_suppkey || '.class' FROM supplier WHERE s_suppkey % 10 = 0)
    SELECT 'n' || s_nationkey || '-' || g || '.jar' AS file, entry, (row_number() OVER (PARTITION BY s_nationkey, g ORDER BY entry) - 1)::INT AS place FROM e""",
)
def _(t):
    got = classes.archive_entries(t.spark, _repository(t), glob="n*[0-9].jar")
    return got.select(F.substring_index("path", "/", -1).alias("file"), "entry", "place")


@query(
    "J09b_inherited_signatures",
    f"SELECT {OWNER} AS owner, 'extends' AS kind, {BASE} AS target FROM supplier UNION ALL SELECT {OWNER}, 'implements', 'java/lang/Runnable' FROM supplier WHERE s_suppkey % 2 = 0",
)
def _(t):
    return classes.signature_edges(_symbols(t))


def _joined(t):
    root = _repository(t)
    return java_source.join_sources(classes.read_symbols(t.spark, root, glob="n*[0-9].jar"), java_source.read_sources(t.spark, root, glob="*-sources.jar"))


@query("S05_source_declarations", f"SELECT {OWNER} AS owner, 'run' AS name, '(I)V' AS descriptor, 'amount' AS parameters, 'Runs with {{@code amount}}.' AS doc FROM supplier")
def _(t):
    return _joined(t)[0].select("owner", "name", "descriptor", F.array_join("parameters", ",").alias("parameters"), "doc")


@query("J03c_unmatched_declarations", f"SELECT {OWNER} AS owner, '<init>' AS name, '()V' AS descriptor, 0 AS matches FROM supplier")
def _(t):
    """The default constructor isn't written in the source."""
    return _joined(t)[1]


@query("S09_source_namespaces", f"SELECT 'n' || s_nationkey AS package, {OWNER} AS top, {OWNER} || '$Inner' AS nested FROM supplier")
def _(t):
    got = java_source.namespaces(java_source.read_sources(t.spark, _repository(t), glob="*-sources.jar"))
    return got.select("package", "top", F.array_join("nested", ",").alias("nested"))


@query("K03b_documentation_overlay", "SELECT count(*) AS documented, count(*) AS unmatched, count(*) AS shown FROM supplier")
def _(t):
    """Documentation is published under the digest of its rows, read back as an overlay, and wins over what was there."""
    matched, unmatched = _joined(t)
    docs = matched.select("owner", "name", "descriptor", "doc")
    store = sink.Generations(t.spark, f"{shared_dir(t.spark).rstrip('/')}/docs-{uuid.uuid4().hex}")
    key = docs.agg(F.sha2(F.sum(F.xxhash64("owner", "name", "descriptor", "doc").cast("decimal(38,0)")).cast("string"), 256).alias("k")).first().k or "empty"
    store.publish(key, docs)
    store.activate(key)
    rows = docs.select("owner", "name", "descriptor", F.lit("old").alias("old")).join(store.read(), ["owner", "name", "descriptor"], "left")
    shown = rows.where(F.coalesce("doc", "old").startswith("Runs with")).agg(F.count("*").alias("shown"))
    return docs.agg(F.count("*").alias("documented")).join(unmatched.agg(F.count("*").alias("unmatched"))).join(shown)


@query("P01b_parameter_names", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'void f(int arg0, arg0x y)' ELSE 'void f(int ' || lower(p_type) || ', arg0x y)' END AS signature FROM part")
def _(t):
    """Names from the source stand in a signature unless the class file has names of its own."""
    return t.part.select("p_partkey", tx.with_names(F.lit("void f(int arg0, arg0x y)"), F.array(F.lit("arg0")), F.array(F.lower("p_type")), F.col("p_partkey") % 2 == 0).alias("signature"))
