"""Helpers shared by the training-data operators: text columns, shared tables, sizes."""
from __future__ import annotations

import ctypes
import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parleo.plans.stage import checkpoint_dir

#: Bytes split by ``bytes.split()``: exactly \x20 and \x09-\x0D.
WHITE = b" \t\n\x0b\x0c\r"


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text binary): only the two columns, null text as empty bytes."""
    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), utf8(docs[text_col]).alias("text"))


def utf8(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def give_back() -> None:
    """Return to the system what Arrow and malloc hold free: Spark uses workers again, also for other steps."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def lean(fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A task function that leaves its worker without memory that it no longer uses."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from fn(batches)
        give_back()
    return run


def map_texts(rows: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``mapInPandas`` for rows with a doc_id: ids travel as text, since pandas turns integers beside nulls into floats."""
    out = rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(lean(fn), schema.replace("doc_id bigint", "doc_id string"))
    return out.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def fold(id_value: int | None, parts: int) -> int:
    """crc32 of the id as text, modulo; a null id counts as the text ''."""
    return zlib.crc32(b"" if id_value is None else str(int(id_value)).encode()) % parts


def fold_col(doc_id: Column, parts: int) -> Column:
    """``fold`` as a column."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def shared_table(df: DataFrame) -> DataFrame:
    """Write a result to the folder that all executors share and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Total bytes of a text column (one small aggregate)."""
    got = docs.agg(F.sum(F.octet_length(docs[text_col].cast("string")))).first()[0]
    return int(got or 0)


@F.pandas_udf(T.BinaryType())
def deflated(text: pd.Series) -> pd.Series:
    """Texts compressed before they are shuffled."""
    return text.map(lambda t: zlib.compress(t, 1))


def inflate(packed: pd.Series) -> list[bytes]:
    return [zlib.decompress(z) for z in packed]


_KINDS = {"bigint": "int64", "int": "int32", "short": "int16", "double": "float64", "boolean": "bool"}


def frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    """Rows as a pandas frame of a flat schema, also where there are none."""
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows)) if rows else [[] for _ in fields]
    return pd.DataFrame({n: pd.Series(list(c), dtype=_KINDS.get(t, "object")) for (n, t), c in zip(fields, cols)})
