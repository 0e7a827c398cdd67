"""Java sources by parse alone: package, imports, nested types and their methods, and their join to class files.

Comments and literals are blanked with their length kept, so offsets are those of the text. Declarations are found by
braces: a block is a type's body if a type keyword precedes it, and a method is a name with a parameter list directly in a
type's body. Nothing is resolved; what doesn't parse is left out.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import descriptor_parameters

SCHEMA = "path string, entry string, package string, imports array<string>, owner string, kind string, name string, parameters array<string>, types array<string>, variables array<string>, doc string, start int"
_BLANK = re.compile(r"/\*.*?(?:\*/|\Z)|//[^\n]*|\"\"\".*?(?:\"\"\"|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)
_TYPE = re.compile(r"(?<![\w.])(class|interface|enum|record|@interface)\s+([A-Za-z_$][\w$]*)")
_METHOD = re.compile(r"(?<![\w.@])([A-Za-z_$][\w$]*)\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)\s*(?:throws\s+[\w.,\s]+)?$")
_DOC = re.compile(r"/\*\*(?!/)(.*?)\*/", re.S)
_NO_METHOD = frozenset("if for while switch catch synchronized return new try do else super this assert throw".split())


def blanked(text: str) -> str:
    """The text with comments and literals replaced by spaces; lines and offsets stay."""
    return _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def split_top(text: str, sep: str = ",") -> list[str]:
    """Parts at commas that stand in no angle or round brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "<(") - (c in ">)")
        if c == sep and depth == 0:
            out.append(text[start:i])
            start = i + 1
    return [p.strip() for p in [*out, text[start:]] if p.strip()]


def erased(written: str) -> str:
    """A parameter's type without annotations, modifiers and type arguments; varargs are an array."""
    bare = re.sub(r"@[\w.]+(?:\([^()]*\))?|\bfinal\b", " ", written)
    while (less := re.sub(r"<[^<>]*>", "", bare)) != bare:
        bare = less
    return re.sub(r"\s+", "", bare.replace("...", "[]"))


def type_variables(text: str) -> list[str]:
    """Names declared in the angle brackets that ``text`` begins with; none if it doesn't."""
    text, depth = text.lstrip(), 0
    if not text.startswith("<"):
        return []
    for i, c in enumerate(text):
        depth += (c == "<") - (c == ">")
        if depth == 0:
            return [re.split(r"\s", re.sub(r"@[\w.]+\s*", "", p))[0] for p in split_top(text[1:i])]
    return []


def _parameters(text: str) -> tuple[list[str], list[str]]:
    names, types = [], []
    for p in split_top(text):
        m = re.fullmatch(r"(.*?[\s\].>])([A-Za-z_$][\w$]*)((?:\[\])*)", p, re.S)
        if m:
            names.append(m[2])
            types.append(erased(m[1]) + m[3])
    return names, types


def _doc_before(text: str, docs: list[re.Match], at: int) -> str | None:
    """The documentation comment that ends before ``at`` with nothing but modifiers between."""
    for m in reversed(docs):
        if m.end() <= at:
            if not re.search(r"[;{}]", blanked(text[m.end() : at])):
                return "\n".join(re.sub(r"^\s*\* ?", "", x) for x in m[1].strip().split("\n")).strip()
            return None
    return None


def parse_source(text: str) -> tuple[str, list[str], list[tuple]]:
    """(package, imports, declarations), owners as binary names.

    A declaration is (owner, kind, name, parameters, types, type variables in scope, doc, start).
    """
    bare, docs = blanked(text), list(_DOC.finditer(text))
    m = re.search(r"(?m)^\s*package\s+([\w.]+)\s*;", bare)
    package = m[1] if m else ""
    imports = re.findall(r"(?<![\w.])import\s+((?:static\s+)?[\w.]+(?:\.\*)?)\s*;", bare)
    out: list[tuple] = []
    stack: list[tuple[str, list[str]] | None] = []  # the type whose body a block is and its type variables, or None
    since = 0
    prefix = package.replace(".", "/") + "/" if package else ""
    for m in re.finditer(r"[{};]", bare):
        head, at = bare[since : m.start()], since
        since = m.end()
        inside, known = (stack[-1] or (None, [])) if stack else ("", [])
        if m[0] == "}":
            if stack:
                stack.pop()
            continue
        found = _TYPE.search(head) if m[0] == "{" and inside is not None else None
        if found:
            owner = f"{inside}${found[2]}" if inside else prefix + found[2]
            start = at + found.start()
            out.append((owner, found[1].lstrip("@") if found[1] != "@interface" else "annotation", found[2], None, None, None, _doc_before(text, docs, start), start))
            stack.append((owner, known + type_variables(head[found.end() :])))
            continue
        method = _METHOD.search(head.rstrip()) if inside else None
        if method and method[1] not in _NO_METHOD and "=" not in head[: method.start()]:
            names, types = _parameters(method[2])
            simple = inside.rsplit("/", 1)[-1].rsplit("$", 1)[-1]
            start = at + method.start()
            kind = "constructor" if method[1] == simple else "method"
            own = re.search(r"(?:^|\s)(?=<)", head[: method.start()])
            out.append((inside, kind, "<init>" if kind == "constructor" else method[1], names, types, known + (type_variables(head[own.end() : method.start()]) if own else []), _doc_before(text, docs, start), start))
        if m[0] == "{":
            stack.append(None)
    return package, imports, out


def read_sources(spark: SparkSession, path: str, glob: str = "*.{jar,java}") -> DataFrame:
    """Declarations of all Java sources under ``path``, in archives or as files; archives are the unit of work."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    texts = pa.list_(pa.string())
    kinds = [pa.string(), pa.string(), pa.string(), texts, pa.string(), pa.string(), pa.string(), texts, texts, texts, pa.string(), pa.int32()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def entries(at: str, data: pa.BinaryScalar) -> Iterator[tuple[str, bytes]]:
        if at.endswith(".java"):
            yield at.rsplit("/", 1)[-1], data.as_py()
            return
        try:
            with zipfile.ZipFile(pa.BufferReader(data.as_buffer())) as z:
                for name in sorted(n for n in z.namelist() if n.endswith(".java")):
                    yield name, z.read(name)
        except (zipfile.BadZipFile, OSError, ValueError):
            return

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for entry, data in entries(at, content):
                    package, imports, found = parse_source(data.decode("utf-8", "replace"))
                    if found:
                        rows = [(at, entry, package, imports, *x) for x in found]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.select("path", "content").mapInArrow(parse, SCHEMA)


def namespaces(sources: DataFrame) -> DataFrame:
    """(package, top, nested): a package's top-level types, each with all types nested in it."""
    types = sources.where("parameters is null").select("package", F.substring_index("owner", "$", 1).alias("top"), "owner")
    got = types.groupBy("package", "top").agg(F.array_sort(F.collect_set(F.when(F.col("owner") != F.col("top"), F.col("owner")))).alias("nested"))
    return got.select("package", "top", "nested")


def join_sources(symbols: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matched, unmatched): methods and constructors of class files with the one source declaration they come from.

    Equal owner, name and number of parameters; then every type as written must be the class file's: its qualified name, a
    simple name imported or of the same package, or the end of a nested one. A type variable in scope may stand for any class. What
    has no match, or several, is unmatched with their number.
    """
    b = symbols.where("kind in ('method', 'constructor')").select("owner", "name", "descriptor", descriptor_parameters("descriptor").alias("erased"))
    s = sources.where("parameters is not null").select("owner", "name", "package", "imports", "parameters", "types", "variables", "doc", "start")
    pairs = b.join(s, ["owner", "name"], "left").withColumn("__ok", F.col("types").isNotNull() & (F.size("types") == F.size("erased")))
    base = lambda x: F.regexp_replace(x, r"(?:\[\])+$", "")
    dims = lambda x: F.length(x) - F.length(base(x))

    def same(written, real):
        w, r = base(written), base(real)
        simple = F.element_at(F.split(r, r"\."), -1)
        visible = F.array_contains(F.col("imports"), r) | F.array_contains(F.col("imports"), F.concat(F.regexp_replace(r, r"\.[^.]*$", ""), F.lit(".*"))) | r.startswith("java.lang.") | (F.regexp_replace(r, r"\.[^.]*$", "") == F.col("package")) | ~F.contains(r, F.lit("."))
        nested = F.replace(F.col("owner"), F.lit("/"), F.lit("."))
        variable = F.array_contains(F.col("variables"), w)
        return (dims(written) == dims(real)) & ((w == r) | ((w == simple) & (visible | r.startswith(F.translate(nested, "$", ".")))) | variable)

    fits = F.forall(F.zip_with("types", "erased", lambda w, r: F.struct(w.alias("w"), r.alias("r"))), lambda x: F.coalesce(same(x["w"], x["r"]), F.lit(False)))
    pairs = pairs.withColumn("__hit", F.col("__ok") & fits)
    found = pairs.groupBy("owner", "name", "descriptor").agg(F.count_if("__hit").alias("matches"), F.min_by(F.struct("parameters", "doc", "start"), F.when(F.col("__hit"), F.col("start"))).alias("x"))
    return found.where("matches = 1").select("owner", "name", "descriptor", "x.*"), found.where("matches != 1").select("owner", "name", "descriptor", "matches")
