"""Lifetime totals over failures and restarts; the source of file changes."""

import os
import time

import pytest

from ledgerspark.sources.changes import FileChanges
from ledgerspark.streaming import lifetime as T

SCHEMA = "session_id string, file_path string, occurred_at long, charged_full long, charged_sent long"


def charges(k, n=40):
    return [(f"s{i % 3}", f"f{i % 5}", 86_000 * k + 37 * i, 100 + i, 10 + k) for i in range(n)]


def totals(lifetime):
    return {level: sorted(map(tuple, lifetime.totals(level).collect())) for level in T.LEVELS}


def wanted(spark, waves):
    rows = spark.createDataFrame([r for w in waves for r in w], SCHEMA)
    return {level: sorted(map(tuple, T.rolled(T.part_of(rows), keys).collect())) for level, keys in T.LEVELS.items()}


@pytest.mark.parametrize("fails_after_writing", [True, False])
def test_a_batch_counts_once(spark, tmp_path, fails_after_writing):
    """The query dies in its second batch, before or after that batch's part is written, and is
    begun anew; totals are compacted in between and at the end."""
    lifetime, waves = T.Lifetime(spark, str(tmp_path / "life")), [charges(k) for k in range(4)]
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def put(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def dies(batch, batch_id):
        if batch_id == 1:
            if fails_after_writing:
                lifetime.add(batch, batch_id)
            raise RuntimeError("stopped")
        lifetime.add(batch, batch_id)

    put(waves[0])
    query = source.writeStream.foreachBatch(dies).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    put(waves[1])
    with pytest.raises(Exception, match="stopped"):
        query.processAllAvailable()
    query.stop()
    query = T.sink(source, lifetime, str(tmp_path / "ck")).start()
    query.processAllAvailable()
    assert totals(lifetime) == wanted(spark, waves[:2])
    lifetime.compact()
    assert lifetime.batches() == [] and lifetime.snapshot() == 1 and totals(lifetime) == wanted(spark, waves[:2])
    # a batch that the snapshot holds is told again
    lifetime.add(spark.createDataFrame(waves[1], SCHEMA), 1)
    for w in waves[2:]:
        put(w)
        query.processAllAvailable()
    query.stop()
    assert totals(lifetime) == wanted(spark, waves)
    lifetime.compact()
    lifetime.compact()
    assert totals(lifetime) == wanted(spark, waves) and sorted(os.listdir(tmp_path / "life" / "snapshots")) == ["3"]


def test_compaction_stopped_midway(spark, tmp_path, monkeypatch):
    """The new snapshot is there, the pointer isn't: the old state counts, and it can go on."""
    lifetime, waves = T.Lifetime(spark, str(tmp_path / "life")), [charges(k) for k in range(3)]
    assert lifetime.totals("headline").collect()[0].reads == 0
    for k, w in enumerate(waves):
        lifetime.add(spark.createDataFrame(w, SCHEMA), k)

    def stopped(batch):
        raise RuntimeError("stopped")

    monkeypatch.setattr(lifetime, "_point", stopped)
    with pytest.raises(RuntimeError):
        lifetime.compact()
    assert totals(lifetime) == wanted(spark, waves)
    monkeypatch.undo()
    lifetime.compact()
    assert totals(lifetime) == wanted(spark, waves) and lifetime.batches() == []


def test_file_changes(spark, tmp_path):
    """Created, modified and removed files over a restart; a listing is compared in shards."""
    root = tmp_path / "tree"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_text("alpha")
    (root / "sub" / "é.txt").write_text("beta")
    spark.dataSource.register(FileChanges)
    source = spark.readStream.format("file_changes").options(state=str(tmp_path / "state"), debounce=0, shards=3).load(str(root))

    def until_done():
        query = source.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination(60)
        query.stop()

    def seen():
        return sorted(((r.path, r.change, r.n_bytes) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=lambda r: r[:2])

    until_done()
    first = [("a.txt", "created", 5), ("sub/é.txt", "created", 4)]
    assert seen() == first
    (root / "a.txt").write_text("alpha beta")
    os.remove(root / "sub" / "é.txt")
    (root / "sub" / "new.txt").write_text("")
    until_done()
    second = [("a.txt", "modified", 10), ("sub/new.txt", "created", 0), ("sub/é.txt", "removed", None)]
    assert seen() == sorted([*first, *second], key=lambda r: r[:2])
    until_done()
    assert len(seen()) == 5
    assert len([x for x in os.listdir(tmp_path / "state") if x.startswith("listing-")]) <= 2


def test_file_changes_are_debounced(tmp_path):
    """A path that keeps changing is told once it has been still; before, as it was known."""
    root = tmp_path / "tree"
    root.mkdir()
    reader = FileChanges({"path": str(root), "state": str(tmp_path / "state"), "debounce": "300", "shards": "2"}).streamReader(None)
    old = time.time() - 10
    (root / "a").write_text("1")
    os.utime(root / "a", (old, old))
    assert reader.initialOffset() == {"listing": 0} and reader.latestOffset() == {"listing": 1} and reader.latestOffset() == {"listing": 1}
    for text in ("12", "123"):
        (root / "a").write_text(text)
        (root / "b").write_text(text)
        assert reader.latestOffset() == {"listing": 1}
    for p in ("a", "b"):
        os.utime(root / p, (old + 1, old + 1))
    assert reader.latestOffset() == {"listing": 2}
    rows = lambda a, b: sorted(r[:3] for p in reader.partitions({"listing": a}, {"listing": b}) for r in reader.read(p))
    assert rows(0, 1) == [("a", "created", 1)] and rows(1, 2) == [("a", "modified", 3), ("b", "created", 3)]
    # another reader, as after a restart, goes on from the last listing, told again or not
    other = FileChanges({"path": str(root), "state": str(tmp_path / "state"), "debounce": "0", "shards": "2"}).streamReader(None)
    os.remove(root / "b")
    assert other.latestOffset() == {"listing": 3}
    reader = other
    assert rows(2, 3) == [("b", "removed", None)] and rows(1, 3) == [("a", "modified", 3)]
    other.commit({"listing": 3})
    assert other._listings() == [3]
    with pytest.raises(ValueError):
        FileChanges({"path": str(root)}).streamReader(None)
