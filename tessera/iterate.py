"""Lineage cuts for iterative plans, in the folder that the session's spark.checkpoint.dir names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def shared_dir(spark) -> str:
    """The folder of ``spark.checkpoint.dir``, or else that of the context.

    Where neither is set, a local master gets a temporary one; on a cluster there is none that all would share.
    """
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or (found.get() if found.isDefined() else None)
    if not known:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="tessera-")
    if not found.isDefined():
        sc.setCheckpointDir(known)
    return known


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and reads it from there, so that lost executors don't undo it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
