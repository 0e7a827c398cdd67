"""Table sinks: generations with a pointer, file-level replacement, reconciliation, inventories, postings.

Everything goes through Spark's own readers and writers and Hadoop's file system API, so that paths may be in any store.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import dotted_prefixes
from ..operators.aggregates import refcounts


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p, jvm.org.apache.hadoop.fs.Path


class Generations:
    """Versioned directories of one table and small numbered pointer files, of which the last counts.

    A pointer is written under a name of its own and renamed to the next number, so whatever breaks off, the pointer before
    it still stands; of two writers at once one gets the number and the other an error. A generation is written under its key to a draft and renamed, so a key is published once; only a validated one can
    become active; the one before stays for rollback; activating the active one again changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, key: str) -> str:
        return f"{self.root}/generation={key}"

    def exists(self, key: str) -> bool:
        fs, p, _ = _fs(self.spark, self._path(key))
        return fs.exists(p)

    def publish(self, key: str, df: DataFrame) -> bool:
        """False if the key was there already: content-addressed keys make a second publication the same."""
        if self.exists(key):
            return False
        draft = f"{self.root}/_draft-{key}"
        df.write.mode("overwrite").parquet(draft)
        fs, p, path = _fs(self.spark, draft)
        return fs.rename(p, path(self._path(key)))

    def read(self, key: str | None = None) -> DataFrame:
        key = key or self.pointer().get("active")
        if key is None:
            raise LookupError("no active generation")
        return self.spark.read.parquet(self._path(key))

    def _pointers(self) -> list[tuple[int, str]]:
        fs, p, _ = _fs(self.spark, f"{self.root}/_pointers")
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted((int(n[:-5]), f"{self.root}/_pointers/{n}") for n in names if n.endswith(".json") and n[:-5].isdigit())

    def pointer(self) -> dict:
        known = self._pointers()
        if not known:
            return {}
        fs, p, _ = _fs(self.spark, known[-1][1])
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _point(self, value: dict) -> None:
        known = self._pointers()
        fs, draft, path = _fs(self.spark, f"{self.root}/_pointers/draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(value).encode()))
        finally:
            out.close()
        last = known[-1][0] if known else 0
        to = path(f"{self.root}/_pointers/{last + 1:020d}.json")
        if fs.exists(to) or not fs.rename(draft, to):
            fs.delete(draft, False)
            raise RuntimeError("another writer has moved the pointer")
        for _, old in known[:-1]:
            fs.delete(path(old), False)

    def activate(self, key: str, validate=None) -> None:
        """``validate(df)`` must be true; the active generation becomes the previous one."""
        now = self.pointer()
        if now.get("active") == key:
            return
        if validate is not None and not validate(self.spark.read.parquet(self._path(key))):
            raise ValueError(f"generation {key} isn't valid")
        self._point({"active": key, "previous": now.get("active")})

    def rollback(self) -> None:
        now = self.pointer()
        if not now.get("previous"):
            raise LookupError("no generation to go back to")
        self._point({"active": now["previous"], "previous": now["active"]})


def replace_partitions(df: DataFrame, path: str, *by: str, owners: DataFrame | None = None) -> None:
    """Writes the partitions that ``df`` has and leaves the others; one file's rows are one partition value.

    ``owners``, the partition values that are replaced, also empties those that have no row any more. Their folders are
    deleted one by one after the write, so a run that breaks off leaves old rows, never too few, and can be repeated.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    if owners is None:
        return
    named = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    for row in owners.select(*by).distinct().join(df.select(*by).distinct(), list(by), "left_anti").toLocalIterator():
        fs, p, _ = _fs(spark, "/".join([path.rstrip("/"), *(named(c, str(row[c])) for c in by)]))
        fs.delete(p, True)


def reconcile(table: DataFrame, present: DataFrame, path: str, root: str) -> DataFrame:
    """Rows without those under ``root`` that aren't present any more."""
    gone = table.where(F.col(path).startswith(root)).join(present.select(path), path, "left_anti").select(path)
    return table.join(gone.distinct(), path, "left_anti")


def sweep(inventory: DataFrame, observed: DataFrame, path: str, key: str, complete: bool) -> tuple[DataFrame, DataFrame]:
    """(inventory after a scan, keys that nothing refers to any more). An incomplete scan deletes nothing."""
    seen = observed.select(path, key)
    kept = inventory.join(seen.select(path), path, "left_anti").select(path, key)
    after = seen if complete else seen.unionByName(kept)
    return after, refcounts(inventory, key).join(refcounts(after, key).select(key), key, "left_anti").select(key)


def latest_alias(aliases: DataFrame, path: str, version: str) -> DataFrame:
    rest = [c for c in aliases.columns if c != path]
    return aliases.groupBy(path).agg(F.max_by(F.struct(*rest), version).alias("__x")).select(path, "__x.*")


def semantic_postings(contributions: DataFrame, file: str = "file") -> dict[str, DataFrame]:
    """Tables of reverse, exact-unresolved and prefix-unresolved postings of (file, exports, unresolved, deps)."""
    return {
        "reverse": contributions.select(F.explode("deps").alias("dep"), file).distinct(),
        "exact": contributions.select(F.explode("unresolved").alias("name"), file).distinct(),
        "prefix": contributions.select(F.explode("unresolved").alias("u"), file).select(F.explode(dotted_prefixes("u")).alias("prefix"), file).distinct(),
    }


def read_journal(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Valid records of a JSON journal; damaged ones go to ``_damaged`` instead of failing the read."""
    return spark.read.schema(schema + ", _damaged string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_damaged").json(path)
