"""Cut points between stages, on shared storage so that a lost executor costs nothing."""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder named by the cluster; a private one only where none is set on a single machine (tests)."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local") or not named and sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = named or os.path.join(tempfile.gettempdir(), f"parleo-ckpt-{os.getpid()}")
    sc.setCheckpointDir(path)
    return path


def settle(df: DataFrame) -> DataFrame:
    """Write a result that several branches read, instead of computing it once per branch."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
