"""Diffs made before they are asked for: a materialised view that is kept up by changes.

A row is one of a file's baselines (whatever sessions know it) and the file's content now, with
the diff between them. Rows are dealt to BUCKETS folders by a hash of the path; a refresh
makes the diffs of changed files only, and rewrites only their folders. A read is served a row
only if both hashes are its own: its baseline's and the current content's. So a row that has
gone stale is never served, however late the refresh; such a read's diff is made anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import diff as D
from ..scratch import Scratch

BUCKETS = 64
SCHEMA = "file_path string, old_hash string, new_hash string, diff string, bucket int"


def bucket(path: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def diffs(pairs: DataFrame, contents: DataFrame) -> DataFrame:
    """``file_path, old_hash, new_hash, diff`` of each of those pairs, made once. ``contents`` has
    ``content_hash, content``."""
    old = contents.select(F.col("content_hash").alias("old_hash"), F.col("content").alias("old"))
    new = contents.select(F.col("content_hash").alias("new_hash"), F.col("content").alias("new"))
    both = pairs.select("file_path", "old_hash", "new_hash").where("old_hash <> new_hash").distinct().join(old, "old_hash").join(new, "new_hash")
    return both.select("file_path", "old_hash", "new_hash", D.diff_of(F.col("file_path"), F.col("old"), F.col("new")).alias("diff"))


class Precomputed:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def rows(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.folder)

    def refresh(self, changed: DataFrame, baselines: DataFrame, contents: DataFrame) -> None:
        """``changed``: ``file_path, content_hash`` (null: removed) of files that changed;
        ``baselines``: ``file_path, content_hash`` that some session knows."""
        scratch = Scratch(self.spark, "precomputed")
        now = changed.select("file_path", F.col("content_hash").alias("new_hash"))
        pairs = baselines.select("file_path", F.col("content_hash").alias("old_hash")).join(now.where("new_hash is not null"), "file_path")
        made = diffs(pairs, contents).withColumn("bucket", bucket(F.col("file_path"), self.buckets))
        touched = [r[0] for r in now.select(bucket(F.col("file_path"), self.buckets).alias("b")).distinct().collect()]  # buckets at most
        if not touched:
            return
        others = self.rows().where(F.col("bucket").isin(touched)).join(now.select("file_path"), "file_path", "left_anti")
        whole = scratch.keep(others.unionByName(made), "rows")  # reads the folders before they are replaced
        # a folder that is left empty is replaced too
        empty = self.spark.createDataFrame([(None, None, None, None, b) for b in touched], SCHEMA)
        writer = whole.unionByName(empty).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("bucket").parquet(self.folder)

    def serve(self, reads: DataFrame, contents: DataFrame) -> DataFrame:
        """``reads`` (``file_path, old_hash, new_hash`` and more) with ``diff`` and ``served``: whether it
        was there. What isn't is made anew, once a pair."""
        keys = ["file_path", "old_hash", "new_hash"]
        have = self.rows().where("file_path is not null").select(*keys, "diff", F.lit(True).alias("served"))
        found = reads.join(have, keys, "left")
        fresh = diffs(found.where("served is null"), contents).withColumnRenamed("diff", "fresh")
        both = found.join(fresh, keys, "left")
        return both.withColumns({"diff": F.coalesce("diff", "fresh"), "served": F.coalesce("served", F.lit(False))}).drop("fresh")
