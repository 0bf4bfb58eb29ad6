"""Near duplicates, components and the pipeline against brute force."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerspark.llm import neardup
from ledgerspark.llm.common import Scratch
from ledgerspark.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows):
    sets = []
    for _, x in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", x)
        sets.append(frozenset(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else ()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if rows[i][1] == rows[j][1] or (union and len(sets[i] & sets[j]) >= 0.8 * union):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return collections.Counter((d, least[find(i)]) for i, (d, _) in enumerate(rows))


def family(rng, n, edits):
    """A chain of texts, each a few words off the last: near ones are links, far ones aren't."""
    words = [f"w{rng.randint(0, 300)}" for _ in range(90)]
    out = []
    for _ in range(n):
        for _ in range(edits):
            words[rng.randrange(len(words))] = f"w{rng.randint(0, 300)}"
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    texts = family(rng, 40, 1) + family(rng, 60, 2) + family(rng, 30, 3) + ["same text of five words"] * 5 + ["", None, "  ", "one", "one", "a b", "a b c d e"]
    texts += [" ".join(f"v{rng.randint(0, 9999)}" for _ in range(40)) for _ in range(30)]
    rng.shuffle(texts)
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0]], SCHEMA).repartition(3)


def test_classes(spark, docs):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    got = collections.Counter((r.doc_id, r.class_id) for r in neardup.classes(docs, Scratch(spark, "t")).collect())
    want = brute(rows)
    # white space alone has no words: equal texts only
    assert got == want


def test_blocks_of_one_text_each(spark, docs, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    got = collections.Counter((r.doc_id, r.class_id) for r in neardup.classes(docs, Scratch(spark, "t")).collect())
    assert got == brute(rows)


def test_repeated_footers(spark):
    """Alike as sets, far apart by weights: different footers, repeated 30 times."""
    rng = random.Random(4)
    rows = []
    for k in range(12):
        body = " ".join(f"b{k}x{rng.randint(0, 10**6)}" for _ in range(300))
        for i in range(2):
            footer = " ".join(f"f{k}x{i}x{j}" for j in range(25))
            rows.append((2 * k + i, " ".join([body] + [footer] * 30), "en", "s", 1))
    df = spark.createDataFrame(rows, SCHEMA)
    got = collections.Counter((r.doc_id, r.class_id) for r in neardup.classes(df, Scratch(spark, "t")).collect())
    assert got == brute([r[:2] for r in rows]) and len({c for _, c in got}) == 12


def test_blocks_of_different_classes(spark):
    """A band of one class and a stray costs each text of the class one meeting; texts of
    different classes all meet."""
    rows = [(1, i, 0) for i in range(20_000)] + [(1, 10**6, 1)] + [(2, i, i % 3) for i in range(600)] + [(3, 1, 1), (3, 2, 2)]
    members = spark.createDataFrame(rows, "band long, u long, c long")
    dealt = neardup.dealt(members)
    assert dealt.where("band = 1").count() <= 20_000 + 20_000 // neardup.BLOCK + 2
    groups = collections.defaultdict(list)
    for r in dealt.where("band > 1").collect():
        groups[r.band, r.inner, r.lo, r.hi].append((r.u, r.c))
    met = {(k[0], *sorted((a[0], b[0]))) for k, texts in groups.items() for a in texts for b in texts if a[1] != b[1]}
    assert max(map(len, groups.values())) < 3 * neardup.BLOCK
    assert met == {(2, i, j) for i in range(600) for j in range(i + 1, 600) if i % 3 != j % 3} | {(3, 1, 2)}


def test_recall(spark):
    """Pairs right above the threshold, of which half repeat many shingles: none may be lost
    but for 3e-4 of them, and none below it found."""
    rng, rows, links = random.Random(11), [], {}
    for k in range(400):
        n = rng.randint(60, 300)
        body = [f"b{k}x{i}" for i in range(n)]
        extra = [f"c{k}x{i}" for i in range(n)]
        # two texts of n + t shingles that share n - 4 or more
        t = rng.randint(0, n // 4)
        for i, tail in enumerate((extra[:t], extra[n - t :] if t else [])):
            words = body + tail
            rows.append((2 * k + i, " ".join(words + words * (3 * (k % 2) * i)), "en", "s", 1))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.class_id for r in neardup.classes(df, Scratch(spark, "t")).collect()}
    for k in range(400):
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (rows[2 * k + i][1].split() for i in range(2)))
        links[k] = len(a & b) >= 0.8 * len(a | b)
    found = [got[2 * k] == got[2 * k + 1] for k in range(400)]
    true = [k for k in range(400) if links[k]]
    assert 100 < len(true) < 390 and not any(found[k] for k in range(400) if not links[k])
    assert sum(found[k] for k in true) >= 0.99 * len(true)


def test_long_text_and_clashing_columns(spark):
    long = " ".join(f"w{i % 70_000}" for i in range(300_000))
    rows = [(3, long, "x"), (1, long + " end", "y"), (2, None, None), (None, "", "z"), (5, "a b", "q"), (5, "a b", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string").withColumn("band", F.lit(1)).withColumn("class_id", F.lit("c"))
    got = {(r.doc_id, r.class_id) for r in neardup.classes(df, Scratch(spark, "t")).collect()}
    assert got == {(3, 1), (1, 1), (2, 2), (None, 2), (5, 5)}
    kept = neardup.first_of_each(df, Scratch(spark, "t"))
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 5]


def test_first_of_each(spark, docs):
    kept = neardup.first_of_each(docs, Scratch(spark, "t"))
    classes = {c for _, c in brute([(r.doc_id, r.text or "") for r in docs.collect()])}
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(classes)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert neardup.classes(empty, Scratch(spark, "t")).count() == 0
    assert neardup.first_of_each(empty, Scratch(spark, "t")).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(90)] + [(500, 400 + i) for i in range(50)] + [(7, 7), (None, 3)]
    root = {n: n for e in edges for n in e if n is not None}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        if a is not None and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    linked = {n for a, b in edges if a is not None and a != b for n in (a, b)}
    assert got == {n: find(n) for n in linked}


def test_estimate_follows_similarity():
    import numpy as np

    n = 400
    rows = np.repeat([0, 1], n)
    hashes = np.concatenate([np.arange(n), np.arange(n) + n // 10]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    agree = []
    for salt in range(20):
        who = neardup.signatures(rows, hashes + np.uint64(salt), np.ones(2 * n), 2)
        agree.append((who[0] == who[1]).mean())
    assert abs(np.mean(agree) - (0.9 / 1.1)) < 0.02
    # of weights: a text and its double have the same shares
    who = neardup.signatures(rows, np.tile(np.arange(n), 2).astype(np.uint64), np.repeat([1.0, 2.0], n), 2)
    assert (who[0] == who[1]).mean() > 0.99


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns and 0 < docs.count() <= n
        n = docs.count()
    ids = sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert len(ids) == len(set(ids))
    packed = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert sorted({r.doc_id for r in packed.select("doc_id").collect()}) == ids
    empty = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in any column, repeated rows, a very long text and columns of clashing names go
    through every stage; what is kept keeps all its columns."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    long = " ".join(f"word{i % 5000} and{i % 77}" for i in range(60_000))
    odd = [(None, "a " * 80, None, None, None), (1000, None, "en", "s", None), (1000, None, "en", "s", None), (1001, "", "en", None, 0), (1002, long, None, "s", len(long)), (1003, " \n\t ", "en", "s", 4)]
    more = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    rows = docs.unionByName(more).unionByName(docs.limit(5))
    clashing = ("doc", "key", "band", "votes", "base", "all_spans", "piece", "ids", "n")
    rows = rows.withColumns({c: F.lit(c) for c in clashing if c not in ("base", "all_spans")})  # those two are reserved by the secret scan
    rows.write.parquet(str(tmp_path / "in"))
    now = spark.read.parquet(str(tmp_path / "in"))
    columns, before = now.columns, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, now, "").write.parquet(str(tmp_path / name))
        before, now = now, spark.read.parquet(str(tmp_path / name))
        assert now.columns == columns and 0 < now.count() <= before.count()
    kept = [r.doc_id for r in now.collect()]
    assert len(kept) == len(set(kept)) and 1002 in kept and not {None, 1000, 1001, 1003} & set(kept)
    packed = corpus_pipeline.STAGES[-1][1](spark, now, "")
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(kept)
