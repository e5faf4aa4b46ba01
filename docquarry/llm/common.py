"""What the operators share: Arrow plumbing, row keys, and the tables of a folder."""

from __future__ import annotations

import ctypes
import functools
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.errors import SparkNoSuchElementException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.sources.scratch import shared_dir, spread, written

__all__ = ["documents_only", "keyed", "lean", "release", "shared_dir", "small_batches", "table", "with_columns", "written"]


#: Arrow batches between the JVM and Python hold so many bytes or rows at most, where the session has them at their defaults or beyond.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4000


def small_batches(spark: SparkSession) -> None:
    """Rows of texts in the default batches of 10,000 take tens of MB of either side's memory, several times over."""
    for key, usual, value in (("maxBytesPerBatch", 1 << 26, BATCH_BYTES), ("maxRecordsPerBatch", 10_000, BATCH_ROWS)):
        key = f"spark.sql.execution.arrow.{key}"
        try:
            now = int(re.sub(r"\D", "", spark.conf.get(key)) or 0)
        except SparkNoSuchElementException:  # a version without it
            continue
        if now >= usual:
            spark.conf.set(key, value)


@functools.cache
def _libc() -> Any:
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library keeps its own counsel
        return None


def release() -> None:
    """Give memory that is free back to the system; Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None and hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)


def lean(apply: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``apply``, after which the worker is as small as before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from apply(batches)
        finally:
            release()

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def keyed(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """``df`` written with a key of its own for every row, and the key's name, which is none of ``df``'s."""
    small_batches(df.sparkSession)
    names, key = {c.lower() for c in df.columns}, "_row"
    while key in names:
        key += "_"
    return written(df.withColumn(key, F.monotonically_increasing_id()), what), key


def with_columns(schema: T.StructType, added: list[tuple[str, T.DataType]]) -> T.StructType:
    """``schema`` with columns appended; an input column of an added name is replaced."""
    names = {n.lower() for n, _ in added}
    kept = [f for f in schema.fields if f.name.lower() not in names]
    return T.StructType(kept + [T.StructField(n, t) for n, t in added])


def documents_only(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and text, under fixed names."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
