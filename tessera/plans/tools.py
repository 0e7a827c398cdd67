"""The query tools: find, overview, describe, references, hierarchy, deps, status; arguments are checked on the driver.

A catalog holds the tables: symbols (id, scip, binary_key, name, name_path, owner_id, kind, flags, artifact_id, doc, text,
body_start, body_end), artifacts (artifact_id, gav, kind, path), edges (src, dst, kind), members (workspace_id,
artifact_id, pos) and dependencies (src, dst, scope, winner, reason). Each tool returns a DataFrame, a page of it where the
tool is paged. ``respond`` cuts a page into JSON of a byte budget.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import graph
from ..operators import search as s
from ..operators.layers import first_winner
from ..operators.relations import relationships

STRUCTURAL = ("contains", "extends", "implements", "overrides")
CODE = ("calls", "reads", "writes", "instantiates")


class InvalidArgument(ValueError):
    """Code -32602 of JSON-RPC."""


def check(value, schema: dict, at: str = "value") -> None:
    """Validates arguments against the subset of JSON schema that the tools use."""
    kinds = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}
    kind = schema.get("type")
    if kind and (not isinstance(value, kinds[kind]) or (isinstance(value, bool) and kind in ("integer", "number"))):
        raise InvalidArgument(f"{at} must be {kind}")
    if "enum" in schema and value not in schema["enum"]:
        raise InvalidArgument(f"{at} must be one of {schema['enum']}")
    if "minimum" in schema and value < schema["minimum"] or "maximum" in schema and value > schema["maximum"]:
        raise InvalidArgument(f"{at} is out of range")
    for name in schema.get("required", ()):
        if name not in value:
            raise InvalidArgument(f"{at}.{name} is missing")
    if kind == "object":
        known = schema.get("properties", {})
        for name, v in value.items():
            if name in known:
                check(v, known[name], f"{at}.{name}")
            elif schema.get("additionalProperties", True) is False:
                raise InvalidArgument(f"{at}.{name} is unknown")
    if kind == "array" and "items" in schema:
        for i, v in enumerate(value):
            check(v, schema["items"], f"{at}[{i}]")
    passed = [ok(value, x) for x in schema.get("oneOf", ())]
    if passed and sum(passed) != 1:
        raise InvalidArgument(f"{at} must match exactly one form")
    if schema.get("anyOf") and not any(ok(value, x) for x in schema["anyOf"]):
        raise InvalidArgument(f"{at} matches no form")
    if "not" in schema and ok(value, schema["not"]):
        raise InvalidArgument(f"{at} has a forbidden form")


def ok(value, schema: dict) -> bool:
    try:
        check(value, schema)
    except InvalidArgument:
        return False
    return True


def _bounds(limit: int, most: int, depth: int = 0, deepest: int = 20) -> None:
    check(limit, {"type": "integer", "minimum": 1, "maximum": most}, "limit")
    check(depth, {"type": "integer", "minimum": 0, "maximum": deepest}, "depth")


def cursor_of(cursor: str | None) -> tuple[int, int]:
    """(last id, rows to skip): ``index:<id>`` with id from 1 on goes on after an id, a plain number skips so many rows."""
    if cursor is None:
        return 0, 0
    if m := re.fullmatch(r"index:([1-9][0-9]*)", cursor):
        return int(m[1]), 0
    if re.fullmatch(r"0|[1-9][0-9]{0,17}", cursor):
        return 0, int(cursor)
    raise InvalidArgument("malformed cursor")


@dataclass
class Catalog:
    symbols: DataFrame
    artifacts: DataFrame
    edges: DataFrame
    members: DataFrame | None = None
    dependencies: DataFrame | None = None

    def _scope(self, scope: str, workspace) -> DataFrame:
        """Symbols of the scan set, one per identity, the first in precedence order."""
        got = s.selected_artifacts(self.artifacts, self.members, None if scope == "all" else workspace)
        got = got.where("kind = 'local'") if scope == "workspace" else got.where("kind != 'local'") if scope == "deps" else got
        rows = self.symbols.join(got.select("artifact_id", "precedence", F.col("kind").alias("artifact_kind"), F.col("path").alias("artifact_path")), "artifact_id")
        return first_winner(rows, ["scip"], "precedence", "id")

    def find(self, name_path: str, scope: str = "workspace", kinds: Sequence[str] = (), depth: int = 0, include_body: bool = False, substring: bool = False, limit: int = 50, cursor: str | None = None, workspace=None) -> DataFrame:
        _bounds(limit, 200, depth, 10)
        check(scope, {"enum": ["workspace", "deps", "all"]}, "scope")
        rows = self._scope(scope, workspace)
        rows = rows.where(s.visible("artifact_kind", F.lit(False), "flags"))
        if substring:
            hit = rows.where(s.substring_match(name_path, "name", "name_path"))
        else:
            segments = F.split(F.col("name_path"), "/")
            match = s.exact_identity(name_path, "binary_key", "scip")
            try:
                match = match if tx.is_identity_path(name_path) else match | tx.name_path_matches(name_path, segments, tx.descriptor_parameters("descriptor") if "descriptor" in rows.columns else F.array().cast("array<string>"))
            except ValueError as e:
                raise InvalidArgument(str(e)) from e
            hit = rows.where(match)
        if depth:
            # parents are looked up without the kinds; the kinds apply to what is below them
            # ancestors of each path are exploded, so that it is an equi-join
            up = rows.withColumn("__top", F.explode(tx.path_prefixes("name_path")))
            below = up.join(hit.select(F.col("name_path").alias("__top")).distinct(), "__top", "left_semi")
            below = below.where(tx.depth("name_path") - tx.depth("__top") <= depth).where(s.kind_in("kind", kinds)).drop("__top")
            hit = hit.unionByName(below).dropDuplicates(["scip"])
        else:
            hit = hit.where(s.kind_in("kind", kinds))
        if include_body:
            hit = hit.withColumn("body", tx.body_slice("text", "body_start", "body_end"))
        after, skip = cursor_of(cursor)
        return s.page_with_more(hit, ["id"], limit, {"id": after}, skip)

    def overview(self, path: str | None = None, package: str | None = None, depth: int = 1, limit: int = 100, offset: int = 0) -> DataFrame:
        if (path is None) == (package is None):
            raise InvalidArgument("exactly one of path and package")
        _bounds(limit, 1000, depth, 10)
        rows = self.symbols.where(F.col("source_file") == path) if path is not None else self.symbols.where(tx.package_of("fqn") == package)
        return s.offset_page(rows.where(tx.depth("name_path") < depth), ["name_path", "id"], offset, limit)

    def _ref(self, ref: str) -> DataFrame:
        return self.symbols.where(s.exact_identity(ref, "scip", "binary_key")).select("id").distinct()

    def describe(self, ref: str, detail: str = "summary", depth: int = 0, limit: int = 50) -> DataFrame:
        _bounds(limit, 200, depth, 10)
        check(detail, {"enum": ["summary", "full"]}, "detail")
        ids = self._ref(ref)
        if depth:
            ids = ids.unionByName(graph.closure(self.edges, ids, depth, STRUCTURAL).select("id")).distinct()
        rows = self.symbols.join(ids, "id", "left_semi")
        doc = tx.doc_markdown("doc")
        return s.page_with_more(rows.withColumn("doc", tx.doc_summary(doc) if detail == "summary" else doc), ["id"], limit)

    def references(self, ref: str, direction: str = "in", kinds: Sequence[str] = CODE, depth: int = 1, limit: int = 100) -> DataFrame:
        _bounds(limit, 1000, depth)
        check(direction, {"enum": ["in", "out"]}, "direction")
        check(list(kinds), {"type": "array", "items": {"enum": list(CODE)}}, "kinds")
        got = graph.closure(self.edges, self._ref(ref), depth, kinds, outgoing=direction == "out")
        return got.join(self.symbols, "id").orderBy("level", "id").limit(limit)

    def hierarchy(self, ref: str, direction: str = "up", depth: int = 3, limit: int = 100) -> DataFrame:
        _bounds(limit, 1000, depth)
        check(direction, {"enum": ["up", "down"]}, "direction")
        got = graph.closure(self.edges, self._ref(ref), depth, ("extends", "implements", "overrides"), outgoing=direction == "up")
        return got.join(self.symbols, "id").orderBy("level", "id").limit(limit)

    def relations(self, ref: str, kinds: Sequence[str], outgoing: bool = True) -> DataFrame:
        return relationships(self.edges, self.symbols, self._ref(ref), kinds, outgoing)

    def deps(self, root, scope: str = "all", depth: int = 2, limit: int = 50) -> DataFrame:
        """Nodes within ``depth`` of the root with the winner's version or the reason why one lost."""
        _bounds(limit, 200, depth)
        d = self.dependencies if scope == "all" else self.dependencies.where(F.col("scope") == scope)
        roots = d.sparkSession.createDataFrame([(root,)], f"id {dict(d.dtypes)['src']}")
        got = graph.reach(d, roots, depth).select("id", "level")
        why = d.groupBy(F.col("dst").alias("id")).agg(F.max("winner").alias("winner"), F.min("reason").alias("reason"))
        return got.join(why, "id").orderBy("level", "id").limit(limit)

    def status(self) -> DataFrame:
        one = lambda d, n: d.agg(F.count("*").alias("n")).select(F.lit(n).alias("what"), "n")
        return one(self.artifacts, "artifacts").unionByName(one(self.symbols, "symbols")).unionByName(one(self.edges, "edges"))


def respond(rows: list[dict], budget: int = 64 * 1024) -> list[str]:
    """Pages of JSON of at most ``budget`` bytes: rows are packed in order, a row over the budget has its strings cut.

    ``reassemble`` puts the pages together again.
    """
    pages, held, size = [], [], 2
    for row in rows:
        text = json.dumps(row, ensure_ascii=False, sort_keys=True)
        n = len(text.encode()) + 1
        if n + 2 > budget:
            if held:
                pages.append(json.dumps({"rows": held}, ensure_ascii=False))
                held, size = [], 2
            step = max(1, (budget - 64) // 8)
            parts = [text[i : i + step] for i in range(0, len(text), step)]
            pages += [json.dumps({"part": p, "of": len(parts)}, ensure_ascii=False) for p in parts]
            continue
        if size + n + 10 > budget:
            pages.append(json.dumps({"rows": held}, ensure_ascii=False))
            held, size = [], 2
        held.append(row)
        size += n + 1
    return pages + ([json.dumps({"rows": held}, ensure_ascii=False)] if held else [])


def reassemble(pages: Sequence[str]) -> list[dict]:
    out, parts = [], []
    for p in map(json.loads, pages):
        if "rows" in p:
            out += p["rows"]
        else:
            parts.append(p["part"])
            if len(parts) == p["of"]:
                out.append(json.loads("".join(parts)))
                parts = []
    return out
