"""Checkpoints and other intermediate data, in the folder that driver and executors share."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local folder only where it is unset and Spark is local."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared and sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return shared or os.path.join(tempfile.gettempdir(), "tessera-checkpoints")


def fresh_folder(spark: SparkSession, kind: str) -> str:
    """A new place in the shared folder for data that a result is read from."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage by writing to the shared folder. The files go when nothing refers to the result any more."""
    sc = df.sparkSession.sparkContext
    sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete shuffle files and checkpoints that nothing refers to any more: it does so when the driver's garbage is collected."""
    for _ in range(2):  # Python's references are let go by a thread of their own
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
