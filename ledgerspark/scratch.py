"""Tables written to the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and
    all run on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        base = _own.get(app) or _own.setdefault(app, tempfile.mkdtemp(prefix="ledgerspark-"))
    return base.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage: a lost executor loses none of them.

    ``keep`` writes a frame and reads it again; ``drop`` removes one that is no longer
    read. What is left goes when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.paths = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", {}
        path, fs = self._fs(self.root)
        fs.deleteOnExit(path)

    def _fs(self, where: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        where = f"{self.root}/{name}-{len(self.paths)}"
        df.write.parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        self.paths[id(out)] = (out, where)
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path, fs = self._fs(self.paths[id(df)][1])
            fs.delete(path, True)
