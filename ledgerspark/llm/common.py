"""Shared pieces of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch, shared_dir  # noqa: F401
from ..sources.tables import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; a table of fewer splits than cores is dealt over them. For operators whose
    results don't depend on how their input is dealt."""
    return dealt(table(spark, sf_dir, "documents"), "doc_id")


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text column, a null text as the empty one."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def release() -> None:
    """Hands what a finished task no longer needs back to the system: workers outlive tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def small_batches(spark: SparkSession) -> None:
    """Rows that hold whole texts go to Python a thousand at a time, unless the session says
    otherwise: with Spark's 10000, what is under way can outgrow a small executor."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Bytes of the rows that a join may be told to broadcast.
BROADCAST_BYTES = 8 << 20


def hinted(small: DataFrame, rows: int, width: int = 48) -> DataFrame:
    """A side of a join, to be broadcast if it was counted and is small: ``rows`` of ``width``
    bytes. Others are left to adaptive execution, which goes by the bytes it has written."""
    return F.broadcast(small) if rows * width <= BROADCAST_BYTES else small
