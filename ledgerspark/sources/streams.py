"""File sources and sinks: directories as binary files, action logs as streams, JSON out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, LedgerConfig

ACTION_SCHEMA = T.StructType(
    [
        T.StructField("action_id", T.LongType()), T.StructField("session_id", T.StringType()), T.StructField("occurred_at", T.LongType()), T.StructField("kind", T.StringType()),
        T.StructField("file_path", T.StringType()), T.StructField("content_hash", T.StringType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_lines", T.LongType()), T.StructField("win_start", T.LongType()), T.StructField("win_end", T.LongType()),
    ]
)


def binary_files(spark: SparkSession, root: str, pattern: str = "*", config: LedgerConfig = DEFAULT) -> DataFrame:
    """``path, modified, n_bytes, content`` of a tree; the size filter reaches the source, so
    files over the hard cap aren't read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return df.where(F.col("length") <= config.hard_cap_bytes).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("n_bytes"), "content")


def action_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(ACTION_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def change_stream(changes: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """File changes with repeats within the watermark dropped (a debounce by path)."""
    return changes.withWatermark("changed_at", watermark).dropDuplicatesWithinWatermark(["path"])


def write_json(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)


def with_columns_of(old: DataFrame, new: DataFrame) -> DataFrame:
    """Additive migration: rows of an older and a newer schema together."""
    return old.unionByName(new, allowMissingColumns=True)
