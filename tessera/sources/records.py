"""Results that are kept by the identity of their input, logs of requests, and build models from JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def look_up(memos: DataFrame, wanted: DataFrame, key: str, identity: str) -> DataFrame:
    """(key, result, reason) of wanted (key, identity): HIT with the result, or without one MISS, CHANGED or UNKNOWN.

    CHANGED: kept for another identity; UNKNOWN: the wanted identity is null, which equals nothing.
    """
    kept = memos.select(key, F.col(identity).alias("__kept"), "result")
    got = wanted.select(key, identity).join(kept, key, "left")
    same = F.col(identity) == F.col("__kept")
    reason = F.when(F.col(identity).isNull(), "UNKNOWN").when(F.col("__kept").isNull(), "MISS").when(same, "HIT").otherwise("CHANGED")
    return got.select(key, F.when(same, F.col("result")).alias("result"), reason.alias("reason"))


def keep(memos: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Memos after new results: one row a key, the new one if there is one."""
    return new.select(*memos.columns).unionByName(memos.join(new.select(key), key, "left_anti"))


def write_log(requests: DataFrame, path: str) -> None:
    """Appends one JSON line a request."""
    requests.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


MODEL = "root string, modules array<struct<id:string,path:string,packaging:string>>, nodes array<struct<id:string,name:string,version:string,jar:string>>, edges array<struct<src:string,dst:string,scope:string>>, classpaths map<string,array<string>>"


def read_models(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of build models, one JSON object a line: modules, nodes, edges, and classpaths as (root, scope, place, id)."""
    models = spark.read.schema(MODEL).json(path)
    out = {x: models.select("root", F.explode(x).alias("x")).select("root", "x.*") for x in ("modules", "nodes", "edges")}
    paths = models.select("root", F.explode("classpaths").alias("scope", "ids"))
    return out | {"classpaths": paths.select("root", "scope", F.posexplode("ids").alias("place", "id"))}
