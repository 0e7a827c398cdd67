"""State that follows a live source: queues, subscriptions, trust in watch events, debouncing, rescans.

Each operator has a batch form over a table of events; ``rescans`` and ``debounced_stream`` are streaming queries.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.graph import descendants
from .deltas import changed_only, coalesce_deltas, uncertain


def publish_queue(deltas: DataFrame, state: DataFrame, key: Sequence[str], version: str, digest: str, size: str, budget: int) -> DataFrame:
    """What a queue of ``budget`` bytes holds: each key's latest delta, if it differs from the state; the newest that fit.

    Every delta is taken to have a byte at least, so the ``budget`` newest rows are all that can fit; only they are summed.
    """
    latest = changed_only(coalesce_deltas(deltas, key, version), state, key, digest)
    newest = latest.orderBy(F.desc(version), *key).limit(budget)
    total = F.sum(F.greatest(F.col(size), F.lit(1))).over(Window.orderBy(F.desc(version), *key).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return newest.withColumn("__total", total).where(F.col("__total") <= budget).drop("__total")


def subscribed(known: DataFrame, requests: DataFrame, key: str, at: str, capacity: int) -> DataFrame:
    """(key, at, status): lookups that are kept, the ``capacity`` last asked for; older ones are UNKNOWN."""
    asked = known.select(key, at).unionByName(requests.select(key, at)).groupBy(key).agg(F.max(at).alias(at))
    kept = asked.orderBy(F.desc(at), key).limit(capacity).select(key).withColumn("__kept", F.lit(True))
    return asked.join(kept, key, "left").select(key, at, F.when(F.col("__kept"), "FOUND").otherwise("UNKNOWN").alias("status"))


def refreshed(observations: DataFrame, changed: DataFrame, key: str, lookup: Callable[[DataFrame], DataFrame], value: str) -> DataFrame:
    """Observations (key, value, status) after a publication: those of changed keys are looked up again, others stay.

    ``lookup(keys)`` gives (key, value); a key that it has no row for is ABSENT. UNKNOWN ones are not looked up.
    """
    touched = observations.where("status != 'UNKNOWN'").join(changed.select(key).distinct(), key, "left_semi").select(key)
    now = touched.join(lookup(touched).select(key, F.col(value).alias("__new")), key, "left").withColumn("__again", F.lit(True))
    status = F.when(~F.coalesce("__again", F.lit(False)), F.col("status")).when(F.col("__new").isNull(), "ABSENT").otherwise("FOUND")
    return observations.join(now, key, "left").select(key, F.when(F.col("__again"), F.col("__new")).otherwise(F.col(value)).alias(value), status.alias("status"))


def live_state(events: DataFrame) -> DataFrame:
    """(path, present, epoch, trusted) of watch events (seq, path, kind): create, modify, delete, overflow, reconcile.

    An overflow begins an epoch of its own and makes all that was seen before it untrusted, until a reconcile after it or
    an event of the path's own.
    """
    marks = events.groupBy().agg(F.max(F.when(F.col("kind") == "overflow", F.col("seq"))).alias("lost"), F.max(F.when(F.col("kind") == "reconcile", F.col("seq"))).alias("checked"), F.count_if(F.col("kind") == "overflow").alias("epoch"))
    last = events.where("path is not null and kind in ('create', 'modify', 'delete')").groupBy("path").agg(F.max_by("kind", "seq").alias("kind"), F.max("seq").alias("seq"))
    safe = F.col("lost").isNull() | (F.col("seq") > F.col("lost")) | F.coalesce(F.col("checked") > F.col("lost"), F.lit(False))
    return last.crossJoin(F.broadcast(marks)).select("path", (F.col("kind") != "delete").alias("present"), "epoch", safe.alias("trusted"))


def debounced(events: DataFrame, key: str, at: str, quiet: int, longest: int) -> DataFrame:
    """(key, first, last, n): one row for each action on a key: after ``quiet`` without an event, or ``longest`` after the first.

    Times are whole numbers of one unit. The last event of each action counts; ``n`` are those that it stands for.
    """
    w = Window.partitionBy(key).orderBy(at)
    burst = events.select(key, at).withColumn("__new", F.coalesce((F.col(at) - F.lag(at).over(w) >= quiet).cast("int"), F.lit(1)))
    burst = burst.withColumn("__burst", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    began = F.min(at).over(Window.partitionBy(key, "__burst"))
    cut = burst.withColumn("__part", F.floor((F.col(at) - began) / longest))
    return cut.groupBy(key, "__burst", "__part").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).select(key, "first", "last", "n")


def debounced_stream(stream: DataFrame, key: str, ts: str, quiet: str = "200 milliseconds", late: str = "30 seconds") -> DataFrame:
    """The same as a stream: session windows by gap, closed by the watermark."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, quiet).alias("session"), key).agg(F.max(ts).alias("last"), F.count("*").alias("n"))


def rescans(spark: SparkSession, scan: Callable[[int], None], checkpoint: str, every: str = "60 seconds") -> StreamingQuery:
    """Runs ``scan(n)`` for each tick of a stream, at once and then every ``every``; a tick that fails is run again."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda _batch, n: scan(n)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def stale(state: DataFrame, units: DataFrame, contains: DataFrame, unit: str, identity: str) -> DataFrame:
    """Facts are kept, their units marked stale, and the identities of all units below these dropped.

    ``contains``: (src, dst) of units.
    """
    below = descendants(contains, units.select(F.col(unit).alias("id"))).withColumnRenamed("id", unit).withColumn("__below", F.lit(True))
    marked = uncertain(state, units, unit)
    return marked.join(below, unit, "left").withColumn(identity, F.when(F.col("__below"), None).otherwise(F.col(identity))).drop("__below").select(*state.columns)


def dispatched(requests: DataFrame, session: str, priority: str, seq: str) -> DataFrame:
    """Requests with their ``place`` in the queue of their session, from 1: the highest priority first, among equals the first to come."""
    return requests.withColumn("place", F.row_number().over(Window.partitionBy(session).orderBy(F.desc(priority), seq)))
