"""A store of contents by hash: Parquet in folders of the hash's first digits.

A content is written once, whatever the number of files that have it. Reads name hashes and touch
only the folders these begin with. Compaction and removal rewrite only the folders that they
change, as a new base that counts in place of what is there; a reader that started before finds
what it listed until the next ``sweep``. One writer at a time.

Layout: ``add-<n>-<id>/prefix=<digits>`` and ``base-<n>-<id>/prefix=<digits>``, numbered as they were
written. Of a prefix its newest base counts and what was added after it; a write that wasn't
finished doesn't count.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "content_hash string, content string, prefix string"


class ContentStore:
    def __init__(self, spark: SparkSession, folder: str, digits: int = 2):
        self.spark, self.folder, self.digits = spark, folder.rstrip("/"), digits

    def prefix(self, content_hash: Column) -> Column:
        return F.substring(content_hash, 1, self.digits)

    def _fs(self, where: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, where: str) -> list[str]:
        path, fs = self._fs(where)
        return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []

    def parts(self) -> dict[str, list[str]]:
        """The folders that count, by prefix: of each the newest base, and what was added."""
        done = [x for x in self._names(self.folder) if "_SUCCESS" in self._names(f"{self.folder}/{x}")]
        bases = sorted(x for x in done if x.startswith("base-"))
        replaced: dict[str, str] = {}
        for base in bases:  # in the order they were written
            for p in self._names(f"{self.folder}/{base}"):
                if p.startswith("prefix="):
                    replaced[p] = base
        # an added part counts for a prefix unless a later base took it in
        out: dict[str, list[str]] = {p: [f"{self.folder}/{base}/{p}"] for p, base in replaced.items()}
        for part in (x for x in done if x.startswith("add-")):
            for p in self._names(f"{self.folder}/{part}"):
                if p.startswith("prefix=") and (p not in replaced or self._serial(part) > self._serial(replaced[p])):
                    out.setdefault(p, []).append(f"{self.folder}/{part}/{p}")
        return out

    @staticmethod
    def _serial(name: str) -> int:
        return int(name.split("-")[1])

    def _next(self) -> int:
        return max((self._serial(x) for x in self._names(self.folder) if x.count("-") == 2), default=0) + 1

    def _write(self, rows: DataFrame, gone: DataFrame, kind: str) -> str:
        """Writes each of ``rows`` once, without those in ``gone`` (``content_hash``). Contents are
        dealt by prefix, which is how they are written, and by nothing else before."""
        where = f"{self.folder}/{kind}-{self._next():012d}-{uuid.uuid4().hex[:8]}"
        none = gone.select("content_hash", F.lit(None).cast("string").alias("content"), self.prefix(F.col("content_hash")).alias("prefix"), F.lit(True).alias("gone"))
        both = rows.select("content_hash", "content", "prefix", F.lit(False).alias("gone")).unionByName(none).repartition("prefix")
        one = both.groupBy("prefix", "content_hash").agg(F.first("content", ignorenulls=True).alias("content"), F.max("gone").alias("gone"))
        one.where("not gone").select("content_hash", "content", "prefix").write.partitionBy("prefix").parquet(where)
        return where

    def read(self, hashes: DataFrame | None = None) -> DataFrame:
        """``content_hash, content, prefix`` of the whole store, or of the ``content_hash`` in
        ``hashes``, whose folders alone are read."""
        parts = self.parts()
        if hashes is not None:
            wanted = hashes.select("content_hash").distinct()
            some = {r[0] for r in wanted.select(self.prefix(F.col("content_hash"))).distinct().collect()}  # 16 ** digits at most
            parts = {p: v for p, v in parts.items() if p.split("=")[1] in some}
        paths = [x for v in parts.values() for x in v]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        found = self.spark.read.schema("content_hash string, content string").parquet(*paths).where("content_hash is not null").withColumn("prefix", self.prefix(F.col("content_hash")))
        return found if hashes is None else found.join(wanted, "content_hash", "left_semi")

    def add(self, contents: DataFrame) -> int:
        """Adds those of ``content_hash, content`` that aren't there yet; gives how many. Rows whose
        hash isn't 64 hex digits, or isn't their content's, are refused."""
        rows = contents.select("content_hash", "content").where(F.rlike("content_hash", F.lit("^[0-9a-f]{64}$")))
        bad = rows.where(F.sha2("content", 256) != F.col("content_hash"))
        if not bad.isEmpty():
            raise ValueError(f"not its content's hash: {bad.first().content_hash}")
        where = self._write(rows.withColumn("prefix", self.prefix(F.col("content_hash"))), self.read(rows), "add")
        n = self.spark.read.schema(SCHEMA).parquet(where).count()
        if not n:
            self._drop(where)
        return n

    def _drop(self, where: str) -> None:
        path, fs = self._fs(where)
        fs.delete(path, True)

    def compact(self, most: int = 1) -> list[str]:
        """Rewrites the folders that are in more than ``most`` parts; gives their prefixes."""
        many = sorted(p.split("=")[1] for p, v in self.parts().items() if len(v) > most)
        if many:
            self._write(self.read().where(F.col("prefix").isin(many)), self.spark.createDataFrame([], SCHEMA), "base")
        return many

    def remove(self, orphans: DataFrame) -> list[str]:
        """Rewrites the folders that hold some of the ``content_hash`` in ``orphans`` without them."""
        gone = orphans.select("content_hash").distinct()
        touched = sorted(r[0] for r in self.read(gone).select("prefix").distinct().collect())
        if touched:
            own = F.col("prefix").isin(touched)
            # a folder that is left empty still has to replace what was there
            empty = self.spark.createDataFrame([(None, None, p) for p in touched], SCHEMA)
            self._write(self.read().where(own).unionByName(empty), gone.where(self.prefix(F.col("content_hash")).isin(touched)), "base")
        return touched

    def sweep(self) -> int:
        """Deletes what no longer counts, and what was never finished; gives how many folders."""
        live = {x.rsplit("/", 2)[1] for v in self.parts().values() for x in v}
        dead = [x for x in self._names(self.folder) if x.count("-") == 2 and x not in live]
        for x in dead:
            self._drop(f"{self.folder}/{x}")
        return len(dead)
