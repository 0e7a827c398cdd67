"""The corpus pipeline: language ID, near-duplicate join, decontamination, pseudonyms, mixing.

STAGES are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``; ``run`` applies
them in order.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, fresh_dir
from tessera.llm.op03_decontam import decontaminate
from tessera.llm.op04_ngram_join import ngram_jaccard_join
from tessera.llm.op05_pii import pseudonymize
from tessera.llm.op06_langid import UNKNOWN, fit, held_out, identify
from tessera.llm.op07_mixing import mix_sources

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose nearest codeword is farther than this is rejected as no known language: ln 2 is what a text has whose
#: n-grams say nothing, so its bits contradict every codeword. Of 6,000 documents of the test data the farthest had 0.41.
FARTHEST = math.log(2)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those that no codeword is near to."""
    docs = docs.select(*COLUMNS)
    model = fit(docs.where(~held_out("doc_id", 4, 2)))
    found = identify(docs, model)
    return found.where((F.col("__lang_pred") != UNKNOWN) & (F.col("__lang_distance") <= FARTHEST)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates one row stays, that of the smallest doc_id; rows without doc_id come last.

    Rows are told apart by a number of their own: repeated rows are copies of each other, and of two texts under one doc_id
    each is judged by itself. Rows without a word link with nothing and all stay.
    """
    rows = cut(docs.select(*COLUMNS).withColumn("__row", F.monotonically_increasing_id()))
    found = ngram_jaccard_join(rows, "__row").select(F.col("doc_id").alias("__row"), "component_id")
    known = found.join(rows.select("__row", "doc_id"), "__row")
    stays = known.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).alias("x")).select("x.__row")
    gone = found.select("__row").join(stays, "__row", "left_anti")
    return rows.join(gone, "__row", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced; n_chars follows."""
    return pseudonymize(docs.select(*COLUMNS)).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long"))).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mix_sources(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pseudonyms", pseudonyms),
    ("mixing", mixing),
]

#: Learned models and SimHash windows have no SQL form; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
