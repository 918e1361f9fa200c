"""Writers: flat exports, child exports, full records, corrections."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parleo.plans.stage import checkpoint_dir

FORMATS = ("csv", "parquet", "jsonl")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoints, on storage every executor sees."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def export(df: DataFrame, fmt: str, path: str, mode: str = "overwrite") -> str:
    """Write one format; an unknown format is an error."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown export format: {fmt}")
    w = df.write.mode(mode)
    if fmt == "csv":
        w.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        w.json(path)
    return path


def export_all(outputs: dict[str, tuple[DataFrame, str]], folder: str) -> DataFrame:
    """Write every named output and return the manifest (name, format, path)."""
    rows = []
    for name, (df, fmt) in outputs.items():
        rows.append((name, fmt, export(df, fmt, f"{folder}/{name}")))
    return next(iter(outputs.values()))[0].sparkSession.createDataFrame(rows, "name string, format string, path string")


def append_corrections(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def latest_corrections(spark: SparkSession, path: str) -> DataFrame:
    """Last write per call wins."""
    d = spark.read.parquet(path)
    return d.groupBy("call_id").agg(F.max_by("corrections", F.struct("ts", "event_id")).alias("corrections"), F.count(F.lit(1)).alias("n_versions"))
