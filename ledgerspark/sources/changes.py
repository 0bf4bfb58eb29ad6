"""A streaming source of file changes: format ``file_changes``.

    spark.dataSource.register(FileChanges)
    spark.readStream.format("file_changes").option("state", shared).load(folder)

Rows are ``path, change (created, modified, removed), n_bytes, modified_at``. Every trigger lists the
tree; a listing that differs from the last one is written to ``state``, a folder that driver and
executors share, in SHARDS files by a hash of the path, and its number is the offset. Tasks
compare two listings' files shard by shard, so no task holds more than a shard, and a batch that
is told again after a failure compares the same listings. Listings that no batch can ask for
again go once Spark has committed a later one.

A path that changed less than ``debounce`` milliseconds ago is left as it was known until it has
been still for that long, so a burst of writes is one change. The tree is walked by the driver
through the local file system, or whatever is mounted there.
"""

from __future__ import annotations

import json
import os
import time
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SHARDS, DEBOUNCE_MS = 16, 150


class Shard(InputPartition):
    def __init__(self, start: int, end: int, shard: int):
        self.start, self.end, self.shard = start, end, shard


class FileChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_changes"

    def schema(self) -> str:
        return "path string, change string, n_bytes long, modified_at timestamp"

    def streamReader(self, schema: StructType) -> ChangeReader:
        if not self.options.get("path") or not self.options.get("state"):
            raise ValueError("file_changes needs a path to watch and a folder for its state")
        shards = int(self.options.get("shards", SHARDS))
        return ChangeReader(self.options["path"], self.options["state"], shards, float(self.options.get("debounce", DEBOUNCE_MS)) / 1000)


class ChangeReader(DataSourceStreamReader):
    """Listings are numbered from 1; listing 0 is empty."""

    def __init__(self, root: str, state: str, shards: int, debounce: float):
        self.root, self.state, self.shards, self.debounce = root.rstrip("/"), state.rstrip("/"), shards, debounce
        self.last: int | None = None
        self.known: dict[str, list] = {}

    def _folder(self, n: int) -> str:
        return f"{self.state}/listing-{n:012d}"

    def _load(self, n: int, shard: int) -> dict[str, list]:
        if not n:
            return {}
        with open(f"{self._folder(n)}/{shard}.json") as f:
            return json.load(f)

    def _listings(self) -> list[int]:
        return sorted(int(x.split("-")[1]) for x in os.listdir(self.state) if x.startswith("listing-") and x.split("-")[1].isdigit()) if os.path.isdir(self.state) else []

    def walk(self) -> dict[str, list]:
        """``path: [modified, bytes]`` of all files; what can't be read is as good as gone."""
        out, folders = {}, [self.root]
        while folders:
            try:
                entries = list(os.scandir(folders.pop()))
            except OSError:
                continue
            for e in entries:
                try:
                    if e.is_dir(follow_symlinks=False):
                        folders.append(e.path)
                    elif e.is_file(follow_symlinks=False):
                        s = e.stat(follow_symlinks=False)
                        out[os.path.relpath(e.path, self.root)] = [s.st_mtime_ns, s.st_size]
                except OSError:
                    continue
        return out

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        if self.last is None:
            have = self._listings()
            self.last = have[-1] if have else 0
            for shard in range(self.shards):
                self.known |= self._load(self.last, shard)
        now, still = self.walk(), time.time_ns() - int(self.debounce * 1e9)
        for path, entry in list(now.items()):
            if entry[0] > still and entry != self.known.get(path):
                if path in self.known:
                    now[path] = self.known[path]
                else:
                    del now[path]
        if now != self.known:
            self._write(self.last + 1, now)
            self.last, self.known = self.last + 1, now
        return {"listing": self.last}

    def _write(self, n: int, listing: dict[str, list]) -> None:
        """Put in place at once, so a listing that is there is whole."""
        part = f"{self.state}/part-{n:012d}-{os.getpid()}-{time.time_ns()}"
        os.makedirs(part)
        shards: list[dict] = [{} for _ in range(self.shards)]
        for path, entry in listing.items():
            shards[zlib.crc32(path.encode("utf-8", "surrogateescape")) % self.shards][path] = entry
        for k, entries in enumerate(shards):
            with open(f"{part}/{k}.json", "w") as f:
                json.dump(entries, f)
        os.rename(part, self._folder(n))

    def partitions(self, start: dict, end: dict) -> list[Shard]:
        return [Shard(start["listing"], end["listing"], k) for k in range(self.shards)]

    def read(self, partition: Shard) -> Iterator[tuple]:
        from datetime import datetime, timezone

        old, new = (self._load(n, partition.shard) for n in (partition.start, partition.end))
        at = lambda entry: datetime.fromtimestamp(entry[0] / 1e9, timezone.utc)
        for path in sorted(old.keys() | new.keys()):
            a, b = old.get(path), new.get(path)
            if b is None:
                yield path, "removed", None, at(a)
            elif a != b:
                yield path, "created" if a is None else "modified", b[1], at(b)

    def commit(self, end: dict) -> None:
        for n in self._listings():
            if n < end["listing"]:
                for name in os.listdir(self._folder(n)):
                    os.remove(f"{self._folder(n)}/{name}")
                os.rmdir(self._folder(n))

    def stop(self) -> None:
        pass
