"""Column functions over names, paths and documentation; all stay inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def contains_folded(c, needle: str) -> Column:
    """Case-insensitive substring; the needle is literal text, not a pattern."""
    return F.contains(F.lower(col(c)), F.lower(F.lit(needle)))


def grams(c, n: int) -> Column:
    """Distinct n-character grams; texts shorter than n have none.

    They are cut off as blocks of n side by side, once from each of the first n places, so a text costs in proportion to
    its length; a substring by place would be sought from the beginning for each gram.
    """
    s = col(c)
    blocks = [F.regexp_extract_all(F.substr(s, F.lit(first)), F.lit(f"(?s).{{{n}}}"), F.lit(0)) for first in range(1, n + 1)]
    return F.when(F.length(s) >= n, F.array_distinct(F.concat(*blocks))).otherwise(F.array().cast("array<string>"))


def dotted_prefixes(c) -> Column:
    """a.b.c -> [a, a.b, a.b.c]."""
    parts = F.split(col(c), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))


def path_prefixes(c, sep: str = "/") -> Column:
    """Every ancestor directory of a path, the root as the empty string, without the path itself."""
    parts = F.split(col(c), re.escape(sep))
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), sep))


def simple_name(c) -> Column:
    """What follows the last dot or dollar sign."""
    return F.regexp_extract(col(c), r"([^.$]*)$", 1)


def package_of(c) -> Column:
    """What precedes the last dot; the default package is empty."""
    return F.regexp_extract(col(c), r"^(.*)\.[^.]*$", 1)


def depth(c, sep: str = "/") -> Column:
    s = col(c)
    return F.length(s) - F.length(F.replace(s, F.lit(sep), F.lit("")))


def has_flag(c, mask: int) -> Column:
    return col(c).bitwiseAND(mask) != 0


def doc_summary(c) -> Column:
    """The first paragraph."""
    return F.substring_index(col(c), "\n\n", 1)


def hex_padded(c, digits: int) -> Column:
    return F.lower(F.lpad(F.hex(col(c)), digits, "0"))


# Documentation tags and markup, and the Markdown that stands for them, in order.
DOC_RULES = (
    (r"(?s)\{@code\s+([^}]+)}", "`$1`"),
    (r"(?s)\{@literal\s+([^}]+)}", "$1"),
    (r"\{@link(?:plain)?\s+([^}]+)}", "`$1`"),
    (r"(?i)</?p(?:\s[^>]*)?>", "\n\n"),
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?i)</?(?:pre|code)>", "`"),
    (r"(?i)<li>", "\n- "),
    (r"(?i)</?(?:ul|ol|li)>", ""),
    (r"(?i)</?(?:b|strong)>", "**"),
    (r"(?i)</?(?:i|em)>", "*"),
    (r"(?m)^@param\s+(\S+)\s*", "\n- **$1:** "),
    (r"(?m)^@return\s*", "\n**Returns:** "),
    (r"(?m)^@(?:throws|exception)\s+(\S+)\s*", "\n**Throws `$1`:** "),
    (r"(?m)^@see\s*", "\n**See:** "),
)


def doc_markdown(c) -> Column:
    out = col(c)
    for pattern, to in DOC_RULES:
        out = F.regexp_replace(out, pattern, to)
    for entity, to in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"')):
        out = F.replace(out, F.lit(entity), F.lit(to))
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def is_qualified(name: str) -> bool:
    """Identifiers joined by dots; ``$`` counts as a letter."""
    return all(part.replace("$", "_").isidentifier() for part in name.split("."))


def parse_name_path(path: str) -> list[tuple[str, list[str] | None]]:
    """Segments (name, parameters or None) of ``a/b/c(int,String)``; ValueError if it is none."""
    if not path or not path.strip() or len(path) > 8192:
        raise ValueError("a name path has 1 to 8192 characters")
    out: list[tuple[str, list[str] | None]] = []
    for part in path.split("/"):
        m = re.fullmatch(r"([^()]*)(?:\(([^()]*)\))?", part)
        if not m or not is_qualified(m[1]):
            raise ValueError(f"no name or overload: {part!r}")
        params = None
        if m[2] is not None:
            params = [p.strip() for p in m[2].split(",")] if m[2].strip() else []
            for p in params:
                base = re.sub(r"(?:\[\])+$", "", p)
                if base == "void" or not is_qualified(base):
                    raise ValueError(f"no parameter type: {p!r}")
        out.append((m[1], params))
    return out


def is_identity_path(path: str) -> bool:
    """Whether a path is a whole identity, which is compared as it is, instead of names."""
    return path.startswith(("maven ", "local "))


def name_path_matches(path: str, segments, params=None) -> Column:
    """Whether the wanted path is a suffix of ``segments`` (array of names).

    The first wanted segment may also be the end of a dotted name. ``params`` (array of types) is compared with the last
    wanted segment's parameters, which may be simple or qualified names.
    """
    wanted = parse_name_path(path)
    have = col(segments)
    ok = F.size(have) >= len(wanted)
    for i, (name, _) in enumerate(wanted):
        got = F.get(have, F.size(have) - (len(wanted) - i))
        hit = got == name
        ok = ok & (hit | got.endswith("." + name) if i == 0 else hit)
    want = wanted[-1][1]
    if want is not None:
        types = F.transform(col(params), lambda t: F.translate(t, "$", ".")) if params is not None else F.array().cast("array<string>")
        ok = ok & F.coalesce(F.size(types) == len(want), F.lit(False))
        for i, t in enumerate(want):
            t = t.replace("$", ".")
            got = F.get(types, F.lit(i))
            ok = ok & ((got == t) if "." in t else (got == t) | got.endswith("." + t))
    return F.coalesce(ok, F.lit(False))


def line_and_column(text, offset) -> Column:
    """struct(line, column), zero-based code points, of an offset into a text."""
    before = F.substr(col(text), F.lit(1), col(offset))
    return F.struct((F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))).alias("line"), F.length(F.substring_index(before, "\n", -1)).alias("column"))


def body_slice(text, start, end) -> Column:
    """text[start:end) in code points; -1 bounds or a reversed range give null."""
    s, e = col(start), col(end)
    return F.when((s >= 0) & (e >= s), F.substr(col(text), (s + 1).cast("int"), (e - s).cast("int")))


def descriptor_parameters(c) -> Column:
    """Java method descriptor -> array of readable parameter types, in SQL functions."""
    fields = F.regexp_extract_all(F.regexp_extract(col(c), r"^\(([^)]*)\)", 1), F.lit(r"\[*(?:L[^;]+;|[ZBSCIJFD])"), F.lit(0))
    primitive = F.create_map(*[F.lit(x) for pair in (("Z", "boolean"), ("B", "byte"), ("S", "short"), ("C", "char"), ("I", "int"), ("J", "long"), ("F", "float"), ("D", "double")) for x in pair])

    def shown(d: Column) -> Column:
        base = F.replace(d, F.lit("["), F.lit(""))
        dims = F.length(d) - F.length(base)
        name = F.when(base.startswith("L"), F.translate(F.substr(base, F.lit(2), F.length(base) - 2), "/$", "..")).otherwise(primitive[base])
        return F.concat(name, F.repeat(F.lit("[]"), dims))

    return F.transform(fields, shown)


def canonical(*cols) -> Column:
    """A delimiter-safe encoding: each value with its length, null apart from empty."""
    return F.concat(*[F.coalesce(F.concat(F.length(col(c).cast("string")).cast("string"), F.lit(":"), col(c).cast("string")), F.lit("-")) for c in cols])


def digest(*cols) -> Column:
    return F.sha2(canonical(*cols), 256)


def typed(*cols) -> Column:
    """Like ``canonical``, but the number 1 and the text '1' differ: each value carries the first letter of its SQL type."""
    tag = lambda c: F.substr(F.typeof(col(c)), F.lit(1), F.lit(1))
    return F.concat(*[F.concat(tag(c), canonical(c)) for c in cols])


def type_tokens(c) -> Column:
    """A written type as names and signs: ``Map<K,List<V>>`` -> Map < K , List < V > >."""
    return F.regexp_extract_all(col(c), F.lit(r"[\w.$]+|[^\w.$]"), F.lit(0))


def substituted(c, variables, arguments) -> Column:
    """A written type with type variables replaced by arguments of the same place; whole names only, at any depth, at once."""
    known = F.map_from_arrays(col(variables), col(arguments))
    return F.array_join(F.transform(type_tokens(c), lambda x: F.coalesce(F.get(F.map_values(F.map_filter(known, lambda k, v: k == x)), F.lit(0)), x)), "")


def varint(c) -> Column:
    """A whole number from 0 on as the hex of its groups of seven bits, least first, the top bit set on all but the last."""
    n = col(c).cast("long")
    groups = F.when(n >= 0, F.ceil(F.length(F.bin(n)) / 7)).cast("int")
    byte = lambda i: F.call_function("shiftrightunsigned", n, F.lit(7) * i).bitwiseAND(127) + F.when(i < groups - 1, 128).otherwise(0)
    return F.array_join(F.transform(F.sequence(F.lit(0), groups - 1), lambda i: hex_padded(byte(i), 2)), "")


def varint_value(c) -> Column:
    """The number that ``varint`` wrote."""
    s = col(c)
    byte = lambda i: F.conv(F.substr(s, i * 2 + 1, F.lit(2)), 16, 10).cast("long").bitwiseAND(127)
    last = (F.length(s) / 2 - 1).cast("int")
    return F.aggregate(F.reverse(F.sequence(F.lit(0), last)), F.lit(0).cast("long"), lambda acc, i: acc * 128 + byte(i))


def offset_of(text, line, column) -> Column:
    """Offset in code points of a zero-based (line, column); null if the text has no such line or the line is shorter."""
    lines = F.split(col(text), "\n")
    at = F.get(lines, col(line))
    before = F.aggregate(F.slice(lines, F.lit(1), F.greatest(col(line), F.lit(0))), F.lit(0), lambda n, s: n + F.length(s) + 1)
    return F.when((col(column) >= 0) & (col(column) <= F.length(at)), before + col(column))


def json_pointer(c, pointer: str) -> Column:
    """The value at a pointer such as ``/a/0/b`` as JSON text or, if it is a string, as text; ~1 is a slash, ~0 a tilde."""
    steps = [p.replace("~1", "/").replace("~0", "~") for p in pointer.split("/")[1:]]
    path = "$" + "".join(f"[{p}]" if re.fullmatch(r"0|[1-9][0-9]*", p) else f"['{p}']" for p in steps)
    return F.get_json_object(col(c), path)


def json_canonical(c) -> Column:
    """JSON text with sorted keys and without spaces; null if it is none."""
    return F.to_json(F.try_parse_json(col(c)))


def edited(text, edits) -> Column:
    """``text`` with edits, an array of (start, end, new) in code points, applied at once; null if two of them overlap.

    Insertions at one place keep the order of the array.
    """
    order = F.transform(col(edits), lambda e, i: F.struct(e["start"].alias("start"), e["end"].alias("end"), i.alias("i"), e["new"].alias("new")))
    step = lambda s, e: F.struct(
        F.when(e["start"] >= s["at"], F.concat(s["out"], F.substr(col(text), s["at"] + 1, e["start"] - s["at"]), e["new"])).alias("out"), F.greatest(e["end"], s["at"]).cast("int").alias("at")
    )
    done = F.aggregate(F.array_sort(order), F.struct(F.lit("").alias("out"), F.lit(0).cast("int").alias("at")), step)
    return F.concat(done["out"], F.substr(col(text), done["at"] + 1, F.length(col(text))))


def override_eligible(child_flags, parent_flags, child_descriptor, parent_descriptor, same_package) -> Column:
    """Neither is private or static, parameters are equal up to the closing bracket, and the parent is visible."""
    free = lambda c: col(c).bitwiseAND(10) == 0
    before = lambda c: F.substring_index(col(c), ")", 1)
    return free(child_flags) & free(parent_flags) & (before(child_descriptor) == before(parent_descriptor)) & ((col(parent_flags).bitwiseAND(5) != 0) | col(same_package))


def symbol_identity(gav, fqn, key, kind, name, descriptor, overload=None) -> Column:
    """``maven group/artifact version Owner#member(types).`` of a symbol; a type ends with its #.

    ``overload``: a readable return type where only that tells methods apart, else null. Null without three coordinates.
    """
    parts = F.split(col(gav), ":", 3)
    coordinates = F.concat(F.lit("maven "), F.get(parts, F.lit(0)), F.lit("/"), F.get(parts, F.lit(1)), F.lit(" "), F.get(parts, F.lit(2)), F.lit(" "))
    owner = F.concat(F.translate(col(fqn), ".$", "/#"), F.lit("#"))
    ending = F.lit("") if overload is None else F.coalesce(F.concat(F.lit(";return="), col(overload)), F.lit(""))
    called = F.when(col(kind) == "ctor", "<init>").otherwise(col(name))
    method = F.concat(called, F.lit("("), F.array_join(descriptor_parameters(descriptor), ","), ending, F.lit(")."))
    member = F.when(col(key) == col(fqn), "").when(col(kind).isin("method", "ctor"), method).otherwise(F.concat(col(name), F.lit(".")))
    return F.concat(coordinates, owner, member)


def with_names(signature, old, new, stored) -> Column:
    """A signature with parameter names replaced as whole words, place by place, unless ``stored`` says it has its own."""
    pairs = F.zip_with(col(old), col(new), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    done = F.aggregate(pairs, col(signature), lambda s, x: F.regexp_replace(s, F.concat(F.lit(r"\b"), x["a"], F.lit(r"\b")), x["b"]))
    return F.when(col(stored) | (F.size(col(old)) != F.size(col(new))), col(signature)).otherwise(done)
