"""Scans of Java archives and class files: symbols, code edges and class references as DataFrames.

Archives are listed by Spark (``binaryFile``), one row each; members are parsed in Arrow batches. What cannot be parsed is
a row with a warning, never a failure. Names are internal ones, with slashes. Class files follow the public Java Virtual Machine specification.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Constant pool tags of the class file format and the bytes that follow each; access flags; opcodes.
UTF8, CLASS, STRING, FIELD, METHOD, INTERFACE, NAME_TYPE, HANDLE, DYNAMIC, INVOKE_DYNAMIC = 1, 7, 8, 9, 10, 11, 12, 15, 17, 18
SIZES = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}
ACC_BRIDGE, ACC_INTERFACE, ACC_ANNOTATION, ACC_ENUM, ACC_MODULE = 0x40, 0x200, 0x2000, 0x4000, 0x8000
GETSTATIC, PUTSTATIC, GETFIELD, PUTFIELD, INVOKEVIRTUAL, INVOKEINTERFACE, INVOKEDYNAMIC, NEW, CHECKCAST, INSTANCEOF = 178, 179, 180, 181, 182, 185, 186, 187, 192, 193
TABLESWITCH, LOOKUPSWITCH, WIDE, IINC = 170, 171, 196, 132
#: (first opcode, last, bytes of the instruction) where that isn't one.
WIDTHS = ((16, 16, 2), (17, 17, 3), (18, 18, 2), (19, 20, 3), (21, 25, 2), (54, 58, 2), (132, 132, 3), (153, 168, 3), (169, 169, 2), (178, 184, 3), (185, 186, 5), (187, 187, 3), (188, 188, 2), (189, 189, 3), (192, 193, 3), (197, 197, 4), (198, 199, 3), (200, 201, 5))
_WIDTH = [next((w for a, b, w in WIDTHS if a <= op <= b), 1) for op in range(256)]
#: Nested dynamic constants are followed so far.
NESTED = 32

SYMBOLS = (
    "path string, entry string, owner string, kind string, name string, descriptor string, flags int, super string, interfaces array<string>, signature string, parameters array<string>, "
    "refs array<string>, edges array<struct<src:string,kind:string,target:string>>, warning string"
)


class Member:
    """A field or method: its own code, generic signature and parameter names where the class file has them."""

    def __init__(self, name: str, descriptor: str, flags: int, attributes: dict[str, tuple[int, int]]):
        self.name, self.descriptor, self.flags, self.attributes = name, descriptor, flags, attributes


class ClassFile:
    """The parts of one class file that a symbol index needs."""

    def __init__(self, data: bytes):
        if len(data) < 10 or data[:4] != b"\xca\xfe\xba\xbe":
            raise ValueError("not a class file")
        self._d, self._at = data, 8
        self.pool: list = [None]
        n = self._u2()
        while len(self.pool) < n:
            self._constant()
        self.flags, this, sup = self._u2(), self._u2(), self._u2()
        self.name = self._class(this)
        self.super = self._class(sup) if sup else None
        self.interfaces = [self._class(self._u2()) for _ in range(self._u2())]
        self.fields = [self._member() for _ in range(self._u2())]
        self.methods = [self._member() for _ in range(self._u2())]
        self.attributes = self._attributes()

    def _u2(self) -> int:
        self._at += 2
        return struct.unpack_from(">H", self._d, self._at - 2)[0]

    def _u4(self) -> int:
        self._at += 4
        return struct.unpack_from(">I", self._d, self._at - 4)[0]

    def _u2_at(self, at: int) -> int:
        return struct.unpack_from(">H", self._d, at)[0]

    def _constant(self) -> None:
        tag = self._d[self._at]
        self._at += 1
        if tag == UTF8:
            n = self._u2()
            self.pool.append((tag, self._d[self._at : self._at + n].decode("utf-8", "replace")))
            self._at += n
            return
        if tag not in SIZES:
            raise ValueError(f"constant tag {tag}")
        body = self._d[self._at : self._at + SIZES[tag]]
        self._at += SIZES[tag]
        self.pool.append((tag, body[0], *struct.unpack(">H", body[1:])) if tag == HANDLE else (tag, *struct.unpack(">" + "H" * (len(body) // 2), body)))
        if tag in (5, 6):
            self.pool.append(None)

    def _text(self, i: int) -> str:
        return self.pool[i][1]

    def _class(self, i: int) -> str:
        return self._text(self.pool[i][1])

    def _attributes(self) -> dict[str, tuple[int, int]]:
        """name -> (start, end) of each attribute's content."""
        out = {}
        for _ in range(self._u2()):
            name, n = self._text(self._u2()), self._u4()
            out[name] = (self._at, self._at + n)
            self._at += n
        return out

    def _member(self) -> Member:
        flags, name, descriptor = self._u2(), self._text(self._u2()), self._text(self._u2())
        return Member(name, descriptor, flags, self._attributes())

    @property
    def kind(self) -> str:
        for bit, kind in ((ACC_MODULE, "module"), (ACC_ANNOTATION, "annotation"), (ACC_ENUM, "enum"), (ACC_INTERFACE, "interface")):
            if self.flags & bit:
                return kind
        return "record" if "Record" in self.attributes else "class"

    def signature(self, attributes: dict[str, tuple[int, int]]) -> str | None:
        return self._text(self._u2_at(attributes["Signature"][0])) if "Signature" in attributes else None

    def parameters(self, m: Member) -> list[str] | None:
        """Names of a method's parameters, null where the file has none; unnamed ones are empty."""
        if "MethodParameters" not in m.attributes:
            return None
        at = m.attributes["MethodParameters"][0]
        names = [self._u2_at(at + 1 + 4 * i) for i in range(self._d[at])]
        return [self._text(i) if i else "" for i in names]

    def references(self) -> list[str]:
        """Classes of the constant pool, arrays left out, distinct and in order."""
        return sorted({self._text(c[1]) for c in self.pool if c and c[0] == CLASS and not self._text(c[1]).startswith("[")})

    def edges(self) -> list[tuple[str, str, str]]:
        """(src, kind, target), distinct and in order: what the instructions of each method call, read, write and make.

        ``src`` is owner#name descriptor, or the class itself for its static initialiser; targets of the class itself and
        bodies of bridge methods are left out.
        """
        out: set[tuple[str, str, str]] = set()
        for m in self.methods:
            if "Code" in m.attributes and not m.flags & ACC_BRIDGE:
                src = self.name if m.name == "<clinit>" else f"{self.name}#{m.name}{m.descriptor}"
                out.update((src, kind, target) for owner, kind, target in self._uses(m) if owner != self.name)
        return sorted(out)

    def _ref(self, i: int) -> tuple[str, str, str]:
        """(owner, name, descriptor) of a field or method constant."""
        _, owner, named = self.pool[i]
        _, name, descriptor = self.pool[named]
        return self._class(owner), self._text(name), self._text(descriptor)

    def _uses(self, m: Member) -> Iterator[tuple[str, str, str]]:
        for op, i in self._instructions(m.attributes["Code"][0]):
            if op in (GETSTATIC, PUTSTATIC, GETFIELD, PUTFIELD):
                owner, name, _ = self._ref(i)
                yield owner, "reads" if op in (GETSTATIC, GETFIELD) else "writes", f"{owner}#{name}"
            elif INVOKEVIRTUAL <= op <= INVOKEINTERFACE:
                owner, name, descriptor = self._ref(i)
                yield owner, "calls", f"{owner}#{name}{descriptor}"
            elif op == INVOKEDYNAMIC:
                yield from self._bootstrap(self.pool[i][1], 0, set())
            elif op == NEW:
                yield self._class(i), "instantiates", self._class(i)
            elif op in (CHECKCAST, INSTANCEOF):
                # of an array the class of its elements, if they have one
                element = self._class(i).lstrip("[")
                if element == self._class(i):
                    yield element, "reads", element
                elif element.startswith("L"):
                    yield element[1:-1], "reads", element[1:-1]

    def _instructions(self, at: int) -> Iterator[tuple[int, int]]:
        """(opcode, its two-byte operand or 0) along a Code attribute."""
        end = at + 8 + struct.unpack_from(">I", self._d, at + 4)[0]
        start = at = at + 8
        while at < end:
            op = self._d[at]
            if op in (TABLESWITCH, LOOKUPSWITCH):
                body = at + 4 - (at - start) % 4
                low, high = struct.unpack_from(">ii", self._d, body + 4)
                yield op, 0
                at = body + (12 + 4 * (high - low + 1) if op == TABLESWITCH else 8 + 8 * low)
            elif op == WIDE:
                yield op, 0
                at += 6 if self._d[at + 1] == IINC else 4
            else:
                yield op, self._u2_at(at + 1) if _WIDTH[op] >= 3 else 0
                at += _WIDTH[op]

    def _bootstrap(self, number: int, depth: int, seen: set[int]) -> Iterator[tuple[str, str, str]]:
        """What a bootstrap method and its arguments stand for; dynamic constants among them in turn."""
        if "BootstrapMethods" not in self.attributes or depth > NESTED:
            return
        at = self.attributes["BootstrapMethods"][0] + 2
        for _ in range(number):
            at += 4 + 2 * self._u2_at(at + 2)
        yield from self._handle(self._u2_at(at))
        for k in range(self._u2_at(at + 2)):
            i = self._u2_at(at + 4 + 2 * k)
            if i not in seen:
                seen.add(i)
                if self.pool[i][0] == HANDLE:
                    yield from self._handle(i)
                elif self.pool[i][0] == DYNAMIC:
                    yield from self._bootstrap(self.pool[i][1], depth + 1, seen)

    def _handle(self, i: int) -> Iterator[tuple[str, str, str]]:
        _, kind, ref = self.pool[i]
        owner, name, descriptor = self._ref(ref)
        if not owner.startswith("["):
            # kinds 1 and 2 get, 3 and 4 put, the others call
            yield owner, "reads" if kind <= 2 else "writes" if kind <= 4 else "calls", f"{owner}#{name}{descriptor if kind > 4 else ''}"


def _rows(path: str, entry: str, data: bytes) -> Iterator[tuple]:
    try:
        c = ClassFile(data)
        if c.kind == "module" or c.name.endswith("module-info"):
            return
        rows = [(path, entry, c.name, c.kind, c.name.rsplit("/", 1)[-1].rsplit("$", 1)[-1], None, c.flags, c.super, c.interfaces, c.signature(c.attributes), None, c.references(), c.edges(), None)]
        for kind, members in (("field", c.fields), ("method", c.methods)):
            for m in members:
                if m.name != "<clinit>" and not (kind == "method" and m.flags & ACC_BRIDGE):
                    names = c.parameters(m) if kind == "method" else None
                    rows.append((path, entry, c.name, "constructor" if m.name == "<init>" else kind, m.name, m.descriptor, m.flags, None, None, c.signature(m.attributes), names, None, None, None))
    except (ValueError, IndexError, KeyError, TypeError, struct.error) as e:
        rows = [(path, entry, *[None] * 11, f"{type(e).__name__}: {e}")]
    yield from rows


def _members(path: str, data: bytes, release: int, only: str | None = None) -> Iterator[tuple[str, bytes]]:
    """Class entries of an archive; of a multi-release archive each class at the highest version up to ``release``."""
    if path.endswith(".class"):
        yield path.rsplit("/", 1)[-1], data
        return
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        chosen = _chosen(z.namelist(), release)
        for base in sorted(chosen if only is None else chosen.keys() & {f"{only}.class"}):
            yield base, z.read(chosen[base])


def _chosen(names: list[str], release: int) -> dict[str, str]:
    """Class name -> the entry to read: the highest version up to ``release``."""
    best: dict[str, tuple[int, str]] = {}
    for name in names:
        if name.endswith(".class"):
            version, base = 0, name
            if name.startswith("META-INF/versions/"):
                v, _, base = name.removeprefix("META-INF/versions/").partition("/")
                version = int(v) if v.isdigit() else release + 1
            if version <= release and version >= best.get(base, (-1, ""))[0]:
                best[base] = (version, name)
    return {base: name for base, (_, name) in best.items()}


def read_symbols(spark: SparkSession, path: str, release: int = 25, glob: str = "*.{jar,class}", only: str | None = None) -> DataFrame:
    """Symbols, references and code edges of all class files under ``path``; archives are the unit of work.

    ``only``: the name of one class; other entries of archives are not read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    texts, edge = pa.list_(pa.string()), pa.struct([(x, pa.string()) for x in ("src", "kind", "target")])
    kinds = [pa.string()] * 6 + [pa.int32(), pa.string(), texts, pa.string(), texts, texts, pa.list_(edge), pa.string()]
    names = [x.split()[0] for x in SYMBOLS.split(", ")]

    def batch(rows: list) -> pa.RecordBatch:
        columns = [*zip(*rows, strict=True)]
        columns[12] = [x and [dict(zip(("src", "kind", "target"), e, strict=True)) for e in x] for x in columns[12]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows: list = []
                try:
                    for entry, data in _members(at, content.as_py(), release, only):
                        rows += _rows(at, entry, data)
                        if len(rows) >= 4000:
                            yield batch(rows)
                            rows = []
                except (zipfile.BadZipFile, OSError, ValueError) as e:
                    rows.append((at, None, *[None] * 11, f"{type(e).__name__}: {e}"))
                if rows:
                    yield batch(rows)

    return files.select("path", "content").mapInArrow(parse, SYMBOLS)


def discover(spark: SparkSession, path: str) -> DataFrame:
    """(path, role): archives under a repository, binaries before sources, without javadoc archives."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jar").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    role = F.when(F.col("path").endswith("-sources.jar"), "sources").otherwise("binary")
    return files.where(~F.col("path").endswith("-javadoc.jar")).withColumn("role", role).orderBy(F.col("role") == "sources", "path")


def class_references(symbols: DataFrame) -> DataFrame:
    return symbols.where("refs is not null").select("path", F.explode("refs").alias("target")).distinct()


def code_edges(symbols: DataFrame) -> DataFrame:
    """(owner, src, kind, target), distinct: calls, reads, writes and instantiations of other classes by each method."""
    return symbols.where("edges is not null").select("owner", F.explode("edges").alias("e")).select("owner", "e.src", "e.kind", "e.target").distinct()


def archive_entries(spark: SparkSession, path: str, release: int = 25, glob: str = "*.jar") -> DataFrame:
    """(path, length, entry, place): class entries by each archive's own directory, in order; no class is parsed.

    An archive that can't be read has one row without entry.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for at, length, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                try:
                    with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as z:
                        out += [(at, length, name, i) for i, name in enumerate(sorted(_chosen(z.namelist(), release)))]
                except (zipfile.BadZipFile, OSError, ValueError):
                    out.append((at, length, None, None))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)], ["path", "length", "entry", "place"])

    return files.select("path", "length", "content").mapInArrow(scan, "path string, length long, entry string, place int")


def signature_edges(symbols: DataFrame) -> DataFrame:
    types = symbols.where("kind in ('class', 'interface', 'enum', 'annotation', 'record')")
    ext = types.where("super is not null").select("owner", F.lit("extends").alias("kind"), F.col("super").alias("target"))
    return ext.unionByName(types.select("owner", F.lit("implements").alias("kind"), F.explode("interfaces").alias("target")))


def source_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, package, types): package and top-level type names of Java sources, by pattern; comments are stripped."""
    text = spark.read.text(path, wholetext=True, pathGlobFilter="*.java", recursiveFileLookup=True).withColumn("path", F.input_file_name())
    bare = F.regexp_replace("value", r"(?s)/\*.*?\*/|//[^\n]*", " ")
    kinds = r"(?m)^(?:(?:public|final|abstract|sealed|non-sealed|strictfp)\s+)*(?:class|interface|enum|record|@interface)\s+(\w+)"
    return text.select("path", F.regexp_extract(bare, r"(?m)^\s*package\s+([\w.]+)\s*;", 1).alias("package"), F.regexp_extract_all(bare, F.lit(kinds), F.lit(1)).alias("types"))
