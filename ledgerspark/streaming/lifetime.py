"""Lifetime totals of a stream: a sink that counts every batch once.

A micro-batch's charges are added up by session, file and day and written as that batch's part;
a batch that is told again after a failure writes its part again, over the first. Totals are
sums over parts. :func:`Lifetime.compact` folds old parts into a snapshot, which names the last
batch that it holds; a pointer file is put in place last, so a reader or a restart finds either
the old parts or the snapshot, and a batch that the snapshot holds is not counted again.

Layout: ``parts/batch=<id>``, ``snapshots/<last batch id>``, ``current`` (the snapshot's name).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["session_id", "file_path", "day"]
SUMS = ["reads", "tokens_full", "tokens_sent"]
SCHEMA = "session_id string, file_path string, day string, reads long, tokens_full long, tokens_sent long, last_read_at long"
LEVELS = {"headline": [], "per_session": ["session_id"], "per_file": ["file_path"], "daily": ["day"]}


def rolled(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of rows of ``SCHEMA`` by some of its keys."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS]
    return rows.groupBy(*keys).agg(*sums, F.max("last_read_at").alias("last_read_at"))


def part_of(charges: DataFrame) -> DataFrame:
    """SCHEMA of a batch of charges: ``session_id, file_path, occurred_at, charged_full, charged_sent``."""
    day = F.date_format(F.timestamp_seconds("occurred_at"), "yyyy-MM-dd")
    rows = charges.select(
        "session_id", "file_path", day.alias("day"), F.lit(1).cast("long").alias("reads"), F.col("charged_full").alias("tokens_full"),
        F.col("charged_sent").alias("tokens_sent"), F.col("occurred_at").alias("last_read_at"),
    )
    return rolled(rows, KEYS)


class Lifetime:
    """Totals kept in a folder that driver and executors share; one query writes to it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, *names: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *names]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, name: str) -> list[str]:
        path, fs = self._path(name)
        return [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []

    def snapshot(self) -> int:
        """The last batch that is in the snapshot; -1 without one."""
        path, fs = self._path("current")
        if not fs.exists(path):
            return -1
        stream = fs.open(path)
        try:
            return int(stream.readUTF())
        finally:
            stream.close()

    def batches(self) -> list[int]:
        """Batches that have a whole part of their own."""
        done = [int(x.split("=")[1]) for x in self._listed("parts") if x.startswith("batch=") and "_SUCCESS" in self._listed(f"parts/{x}")]
        return sorted(x for x in done if x > self.snapshot())

    def add(self, charges: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``: adds a batch's charges, once however often it is told."""
        if batch_id > self.snapshot():
            part_of(charges).write.mode("overwrite").parquet(f"{self.folder}/parts/batch={batch_id}")

    def rows(self) -> DataFrame:
        """SCHEMA of all that was added; a key may have a row a part."""
        last, parts = self.snapshot(), self.batches()
        paths = ([f"{self.folder}/snapshots/{last}"] if last >= 0 else []) + [f"{self.folder}/parts/batch={x}" for x in parts]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*paths)

    def totals(self, level: str) -> DataFrame:
        """One of LEVELS."""
        return rolled(self.rows(), LEVELS[level])

    def compact(self) -> None:
        """Folds all parts into a new snapshot and removes what it replaces. Stopped anywhere,
        it can be called again."""
        last, parts = self.snapshot(), self.batches()
        if parts:
            new = parts[-1]
            rolled(self.rows(), KEYS).write.mode("overwrite").parquet(f"{self.folder}/snapshots/{new}")
            self._point(new)
            last = new
        for kind, old in (("parts", [x for x in self._listed("parts") if int(x.split("=")[1]) <= last]), ("snapshots", [x for x in self._listed("snapshots") if int(x) < last])):
            for name in old:
                path, fs = self._path(kind, name)
                fs.delete(path, True)

    def _point(self, batch: int) -> None:
        new, fs = self._path("next")
        stream = fs.create(new, True)
        stream.writeUTF(str(batch))
        stream.close()
        current, _ = self._path("current")
        options = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri() if new.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration())
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        overwrite = self.spark.sparkContext._gateway.new_array(rename, 1)
        overwrite[0] = rename.OVERWRITE
        options.rename(fs.makeQualified(new), fs.makeQualified(current), overwrite)


def sink(charges: DataFrame, lifetime: Lifetime, checkpoint: str):
    """A writer of streaming charges into lifetime totals; ``start()`` it."""
    return charges.writeStream.foreachBatch(lifetime.add).outputMode("append").option("checkpointLocation", checkpoint)
