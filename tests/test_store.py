"""Contents by hash, and diffs that are made ahead."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerspark.functions import diff as D
from ledgerspark.operators.precomputed import Precomputed
from ledgerspark.sources.store import ContentStore

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def frame(spark, texts):
    return spark.createDataFrame([(sha(t), t) for t in texts], "content_hash string, content string")


def held(store):
    return {r.content_hash: r.content for r in store.read().collect()}


def test_round_trip_and_idempotence(spark, tmp_path):
    store, texts = ContentStore(spark, str(tmp_path / "s"), 1), [f"text {i} é" for i in range(60)]
    assert store.add(frame(spark, texts[:40] + texts[:5])) == 40
    assert store.add(frame(spark, texts[:40])) == 0 and store.add(frame(spark, texts[30:])) == 20
    assert held(store) == {sha(t): t for t in texts}
    some = frame(spark, [texts[3], texts[50], "elsewhere"])
    assert {r.content for r in store.read(some).collect()} == {texts[3], texts[50]}
    with pytest.raises(ValueError):
        store.add(spark.createDataFrame([("0" * 64, "x")], "content_hash string, content string"))
    assert store.add(spark.createDataFrame([("nothex", "x"), (None, "y")], "content_hash string, content string")) == 0


def test_only_touched_folders_are_rewritten(spark, tmp_path):
    store, texts = ContentStore(spark, str(tmp_path / "s"), 1), [f"text {i}" for i in range(80)]
    store.add(frame(spark, texts[:70]))
    late = [t for t in texts[70:] if sha(t)[0] in "0123456"]
    store.add(frame(spark, late))
    many = sorted({sha(t)[0] for t in late})
    before = {p: v for p, v in store.parts().items() if p.split("=")[1] not in many}
    assert store.compact() == many
    after = store.parts()
    assert {p: after[p] for p in before} == before and all(len(v) == 1 for v in after.values())
    assert held(store) == {sha(t): t for t in texts[:70] + late} and store.compact() == []
    # nothing refers to the first ten texts any more
    touched = store.remove(frame(spark, texts[:10]))
    assert touched == sorted({sha(t)[0] for t in texts[:10]}) and store.remove(frame(spark, texts[:10])) == []
    assert held(store) == {sha(t): t for t in texts[10:70] + late}
    assert store.sweep() >= 1 and held(store) == {sha(t): t for t in texts[10:70] + late}
    assert store.add(frame(spark, texts[:10])) == 10 and held(store) == {sha(t): t for t in texts[:70] + late}


def test_an_unfinished_write_does_not_count(spark, tmp_path):
    store = ContentStore(spark, str(tmp_path / "s"), 1)
    store.add(frame(spark, ["a", "b"]))
    (part,) = os.listdir(tmp_path / "s")
    store.add(frame(spark, ["c"]))
    (other,) = set(os.listdir(tmp_path / "s")) - {part}
    os.remove(tmp_path / "s" / other / "_SUCCESS")
    assert held(store) == {sha(t): t for t in "ab"}
    assert store.add(frame(spark, ["c"])) == 1 and store.sweep() == 1 and held(store) == {sha(t): t for t in "abc"}


def test_served_diffs_equal_fresh_ones(spark, tmp_path):
    """Files change between refreshes and reads: nothing stale is served."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc") + "\n" for _ in range(12)) for _ in range(40)]
    contents = frame(spark, texts).dropDuplicates()
    view = Precomputed(spark, str(tmp_path / "v"), 4)
    pairs = lambda rows, *names: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    known = [(f"f{i % 6}", sha(texts[i])) for i in range(18)]
    baselines = pairs(known, "file_path", "content_hash")
    now = {f"f{i}": sha(texts[20 + i]) for i in range(6)}
    view.refresh(pairs(list(now.items()), "file_path", "content_hash"), baselines, contents)
    was = dict(now)
    now["f1"] = sha(texts[30])  # changed, and not yet refreshed
    reads = [(f, h, now[f]) for f, h in known] + [("f2", sha(texts[39]), now["f2"])]
    text = {sha(t): t for t in texts}

    def check(expected):
        got = {(r.file_path, r.old_hash, r.new_hash): r for r in view.serve(pairs(reads, "file_path", "old_hash", "new_hash"), contents).collect()}
        assert len(got) == len(set(reads))
        for f, a, b in reads:
            r = got[f, a, b]
            assert (D.apply_diff(text[a], r.diff) == text[b]) if a != b else r.diff is None
            if a != b:
                assert r.served == expected(f, a, b)

    check(lambda f, a, b: b == was[f] and (f, a) in known)
    untouched = {b: sorted(os.listdir(tmp_path / "v" / b)) for b in os.listdir(tmp_path / "v") if b.startswith("bucket=")}
    view.refresh(pairs([("f1", now["f1"]), ("f0", None)], "file_path", "content_hash"), baselines, contents)
    check(lambda f, a, b: f != "f0" and (f, a) in known)
    same = [b for b, files in untouched.items() if sorted(os.listdir(tmp_path / "v" / b)) == files]
    assert len(same) >= len(untouched) - 2 and view.rows().where("file_path = 'f0'").isEmpty()
    view.refresh(pairs([], "file_path", "content_hash"), baselines, contents)


def shuffled(spark):
    """Bytes that all stages so far have shuffled."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_contents_are_dealt_once(spark, tmp_path):
    rows = spark.range(300).select(F.concat_ws("", *(F.sha2(F.concat(F.col("id"), F.lit(f"-{k}")), 256) for k in range(100))).alias("content"))
    rows = rows.select(F.sha2("content", 256).alias("content_hash"), "content")
    store, size = ContentStore(spark, str(tmp_path / "s"), 1), 300 * 6400
    for work in (lambda: store.add(rows), lambda: store.add(rows), lambda: store.remove(rows.where("content_hash < '8'"))):
        before = shuffled(spark)
        work()
        assert shuffled(spark) - before < 1.2 * size
    assert sorted(r.content_hash for r in store.read().collect()) == sorted(r[0] for r in rows.where("content_hash >= '8'").select("content_hash").collect())
