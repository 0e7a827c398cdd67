"""Incremental operators as batch functions and as Structured Streaming queries over them.

The model has no event time: changes carry increasing versions per key, and a later version replaces an earlier one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..operators.graph import reverse_closure
from ..operators.layers import apply_edits
from ..operators.relations import keyed_diff, prefix_waiters


def coalesce_deltas(deltas: DataFrame, key: Sequence[str], version: str, tie: str | None = None) -> DataFrame:
    """The latest delta of each key; ties by ``tie``. Partial aggregates, so a hot key needs no task of its own."""
    rest = [c for c in deltas.columns if c not in key]
    order = F.struct(version, tie) if tie else F.struct(version)
    got = deltas.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("__x"))
    return got.select(*key, "__x.*").select(*deltas.columns)


def changed_only(latest: DataFrame, state: DataFrame, key: Sequence[str], digest: str) -> DataFrame:
    """Deltas whose digest differs from the state's."""
    return latest.join(state.select(*key, F.col(digest).alias("__d")), list(key), "left").where(~F.col(digest).eqNullSafe(F.col("__d"))).drop("__d")


def admit(state: DataFrame, snapshot: DataFrame, unit: str, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(state after, changes): the units of ``snapshot`` are compared with the state and replaced; others stay."""
    units = snapshot.select(unit).distinct()
    before = state.join(units, unit, "left_semi")
    changes = keyed_diff(before, snapshot, [unit, key], value)
    gone = changes.where("change = 'removed'").select(unit, key)
    added = snapshot.join(changes.where("change != 'removed'").select(unit, key), [unit, key], "left_semi").select(*state.columns)
    return apply_edits(state, gone, added, [unit, key]), changes


def affected(before: DataFrame, after: DataFrame, depends: DataFrame, unresolved: DataFrame, exports: DataFrame, environment_known: bool = True) -> DataFrame:
    """(id): files to look at again after ``before`` became ``after`` (file, api, body).

    A changed body affects the file alone; a changed or deleted api also all that depend on it, and those that wait for a
    name it exports. An unknown environment affects every file.
    """
    if not environment_known:
        return after.select(F.col("file").alias("id")).unionByName(before.select(F.col("file").alias("id"))).distinct()
    api = keyed_diff(before, after, ["file"], "api").select(F.col("file").alias("id"))
    body = keyed_diff(before, after, ["file"], "body").select(F.col("file").alias("id"))
    names = exports.join(api.withColumnRenamed("id", "file"), "file", "left_semi")
    waiting = prefix_waiters(unresolved, names, "file", "name", "export").select(F.col("file").alias("id"))
    roots = api.unionByName(waiting).distinct()
    return reverse_closure(depends, roots).unionByName(body).distinct()


def uncertain(state: DataFrame, units: DataFrame, unit: str) -> DataFrame:
    """Facts are kept and their units marked stale."""
    return state.join(units.select(unit).withColumn("__s", F.lit(True)), unit, "left").withColumn("status", F.when(F.col("__s"), "STALE").otherwise(F.col("status"))).drop("__s")


def fenced(state: DataFrame, epoch: int) -> DataFrame:
    """Units of an earlier epoch read as UNKNOWN."""
    return state.withColumn("status", F.when(F.col("epoch") < epoch, "UNKNOWN").otherwise(F.col("status")))


def valid_results(proofs: DataFrame, current: DataFrame) -> DataFrame:
    """(consumer, valid): every proof leaf (consumer, domain, key, identity) has its current identity; absent is invalid."""
    got = proofs.join(current.select("domain", "key", F.col("identity").alias("__now")), ["domain", "key"], "left")
    return got.groupBy("consumer").agg(F.bool_and(F.col("identity").eqNullSafe(F.col("__now"))).alias("valid"))


class _Newer(StatefulProcessor):
    """Keeps the last version of each key and passes on what is newer."""

    def __init__(self, version: str, columns: Sequence[str], ttl_ms: int | None):
        self.version, self.columns, self.ttl_ms = version, list(columns), ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "v long", self.ttl_ms) if self.ttl_ms else handle.getValueState("last", "v long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        got = pd.concat(list(rows)).sort_values(self.version)
        fresh = got if last is None else got[got[self.version] > last]
        fresh = fresh.drop_duplicates(self.version, keep="first")
        if len(fresh):
            self.last.update((int(fresh[self.version].iloc[-1]),))
            yield fresh[self.columns]

    def close(self) -> None:
        pass


def version_guard(stream: DataFrame, key: str, version: str, schema: StructType | str | None = None, ttl_ms: int | None = None) -> DataFrame:
    """Stateful: only rows of increasing version per key pass; what is late or repeated is dropped. Needs RocksDB state."""
    schema = schema or stream.schema
    return stream.groupBy(key).transformWithStateInPandas(_Newer(version, stream.columns, ttl_ms), schema, "Append", "None")


def latest_by_batch(stream: DataFrame, path: str, checkpoint: str, key: Sequence[str], version: str, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Micro-batches of the coalesced deltas, one directory per batch id: a batch that is run again replaces its own."""

    def write(batch: DataFrame, n: int) -> None:
        latest = coalesce_deltas(batch, key, version)
        latest.write.mode("overwrite").parquet(f"{path}/batch={n}")
        if then:
            then(latest, n)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, ts: str, by: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """An extension: event-time windows with a watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"))
