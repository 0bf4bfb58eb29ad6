"""Source divergence, fill-in-middle and decontamination against plain versions and SQL."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import decontaminate, divergence, fim
from ledgerspark.llm.common import Scratch

DIR = "/root/testdata/sf0.001"


def duck(**tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t)
    return con


@pytest.mark.parametrize(
    "query, sql", [(divergence.op11_source_divergence, divergence.ORACLE), (fim.op12_fill_in_middle, fim.ORACLE), (decontaminate.op13_decontaminate, decontaminate.ORACLE)]
)
def test_queries_equal_sql(spark, query, sql):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = query(spark, DIR)
    cur = con.execute(sql)
    assert [x[0] for x in cur.description] == got.columns
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, cur.fetchall()))


# --- source divergence


def group_texts(rng, n):
    words = ["aa", "b", "É", "ü", "c7d", "x-y", "ZZ", "zz", "q", "w", "e", "rr"]
    return " ".join(words[min(int(rng.expovariate(0.4)), 11)] for _ in range(n))


@pytest.mark.parametrize("block", [128, 2])
def test_divergence(spark, block):
    rng = random.Random(block)
    rows = [(rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "é", None, "s4"]), group_texts(rng, rng.randint(0, 30))) for _ in range(300)]
    rows += [("xx", "only", ""), ("xx", "two", None), ("yy", "one", group_texts(rng, 50)), rows[0], rows[0]]
    rows += [("en", "s1", "aa " * 200_000)]
    con = duck(documents=pa.table({k: pa.array([r[i] for r in rows], pa.string()) for i, k in enumerate(("lang", "source", "text"))}))
    want = con.execute(divergence.ORACLE.replace(">= 30", ">= 20")).fetchall()
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("term", F.lit("clash")).withColumn("n", F.lit(1)).repartition(3)
    got = divergence.audit(docs, Scratch(spark, "t"), least=20, block=block)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_divergence_of_nothing(spark):
    empty = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.audit(empty, Scratch(spark, "t")).count() == 0


def test_shares_are_exact(spark):
    n, total = 8_999_999_999_999_999, 9_000_000_000_000_123
    got = spark.createDataFrame([(n, total), (0, 0)], "n long, total long").select(divergence.share("n", "total")).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (n + 5) // total, 1]


@pytest.mark.parametrize("held", [divergence.HELD, 5])
def test_partial_counts_are_flushed(spark, held):
    rng = random.Random(5)
    rows = [("en", f"s{i % 3}", group_texts(rng, 40)) for i in range(60)]
    want = collections.Counter()
    for lang, source, text in rows:
        want.update((lang, term, source) for term in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.replace("Z", "z")))
    got = collections.Counter()
    for r in divergence.counts(spark.createDataFrame(rows, "lang string, source string, text string"), held).collect():
        got[r.lang, r.term, r.source] += r.n
    assert got == want


# --- fill in middle


def plain_fim(doc_id, text):
    s = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(s[8 * k : 8 * k + 8], 16) for k in range(4)]
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, x = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    return n, *(("spm", len(p), len(m), f"<S>{x}<P>{p}<M>{m}") if h[3] % 100 < 50 else ("psm", len(p), len(m), f"<P>{p}<S>{x}<M>{m}"))


def line_texts():
    rng = random.Random(1)
    odd = [None, "", "\n", "a", "a\n\n", "<P>", "<P", "x<S>y", "<<P", "<P<S", "\n" * 50, "é\n漢字🙂\n", "<\nP>", "x" * 9000 + "<M>", "x\n" * 9000]
    return odd + ["".join(rng.choice(["\n", "<", "P", ">", "a", "é", "🙂", "S", "bc\n"]) for _ in range(rng.randint(0, 60))) for _ in range(200)]


@pytest.mark.parametrize("piece", [1 << 20, 7])
def test_fill_in_middle(spark, piece):
    texts = [t for t in line_texts() if piece > 7 or len(t or "") < 100]
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts)]
    rows += rows[:4]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("key", F.lit(0)).repartition(3)
    got = fim.transform(docs, Scratch(spark, "t"), piece=piece).withColumn("back", fim.restored("output", "form")).collect()
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_fim(r.doc_id, r.text)
        assert r.back == r.text
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter((d, t or "") for d, t in rows)


def test_giant_text_in_pieces(spark):
    text = "".join(f"line {i} é\n" for i in range(60_000)) + "the end"
    docs = spark.createDataFrame([(11, text), (12, text[:-3]), (11, text)], "doc_id long, text string")
    for r in fim.transform(docs, Scratch(spark, "t"), piece=1 << 16).collect():
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_fim(r.doc_id, r.text)


def test_fill_in_middle_of_nothing(spark):
    assert fim.transform(spark.createDataFrame([], "doc_id long, text string"), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("chunk", [4096, 3])
def test_scan_from_every_state(monkeypatch, chunk):
    monkeypatch.setattr(fim, "CHUNK", chunk)
    raw = [(t or "").encode() for t in line_texts()]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in raw])])
    scan = fim.Scan(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for state in range(fim.STATES):
        at = scan.entered(state)
        for r, text in enumerate(raw):
            now, want = state, []
            for i, byte in enumerate(text):
                if now < 4:
                    want.append(i)
                now = fim._step(fim.KIND[byte], now)
            assert scan.to[r, state] == now and scan.starts[r, state] == len(want)
            assert (at[(at >= offsets[r]) & (at < offsets[r + 1])] - offsets[r]).tolist() == want


# --- decontamination

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(text):
    return TOKEN.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_contamination(docs, items):
    windows = collections.defaultdict(set)
    for i, t in items:
        if w := tokens(t):
            m = min(10, len(w))
            for a in range(len(w) - m + 1):
                windows[tuple(w[a : a + m])].add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, found = tokens(t), set(), set()
        for m in {len(k) for k in windows}:
            for a in range(len(w) - m + 1):
                if tuple(w[a : a + m]) in windows:
                    hit |= set(range(a, a + m))
                    found |= windows[tuple(w[a : a + m])]
        out.append((d, len(w), len(hit), len(found), sorted(found)))
    return out


def leaky(seed):
    """Texts over five words, so that equal hashes and repeats abound."""
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(["a", "b", "É", "ü1", "7"]) + rng.choice(["", ".", "\n"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 5, 7, 9, 10, 11, 14, 30]))) for i in range(40)] + [(None, text(12)), (3, text(12)), (100, None), (7, "...")]
    docs = [(i, text(rng.randint(0, 150)) + " " + (rng.choice(items)[1] or "") + text(5)) for i in range(80)] + [(None, None), (7, ""), (7, "A b")]
    docs.append((999, " ".join(text(3) + " " + (rng.choice(items)[1] or "") for _ in range(800))))  # more than MOST anchors
    return docs, items


@pytest.mark.parametrize("short", [True, False])
def test_decontaminate(spark, short):
    docs, items = leaky(2)
    if not short:
        items = [x for x in items if len(tokens(x[1])) > 9]
    docs = docs + docs[:3]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("some", F.lit(0)).repartition(3)
    got = [tuple(r) for r in decontaminate.contamination(d, spark.createDataFrame(items, "item_id long, text string"), Scratch(spark, "t")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_contamination(docs, items)))


def test_a_long_text_full_of_hits(spark):
    """More anchors than go into one batch: one-word items, a text of 1.5 million words of theirs."""
    docs = [(1, "a b c " * 500_000), (2, "d e f")]
    items = [(1, "a"), (2, "b"), (3, "b c a b"), (4, "x " * 12)]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), Scratch(spark, "t")).collect()
    assert sorted(map(tuple, got)) == [(1, 1_500_000, 1_499_999, 3, ["1", "2", "3"]), (2, 3, 0, 0, [])]


def test_decontaminate_nothing(spark):
    no_items, no_docs = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in decontaminate.contamination(docs, no_items, Scratch(spark, "t")).collect()) == [(1, 3, 0, 0, []), (2, 0, 0, 0, [])]
    assert decontaminate.contamination(no_docs, no_items, Scratch(spark, "t")).count() == 0


def test_every_shared_span_has_an_anchor():
    rng, hashes = np.random.default_rng(3), lambda n: rng.integers(0, 9, n).astype(np.uint64)
    for _ in range(200):
        span, a, b = hashes(10), hashes(rng.integers(0, 40)), hashes(rng.integers(0, 40))
        one, two = np.concatenate([a, span, hashes(7)]), np.concatenate([b, span])
        kept = []
        for x, at in ((one, len(a)), (two, len(b))):
            found = decontaminate.anchors(x, np.array([0, len(x)]), 10, 5, [], None)
            kept.append({(int(k), int(p) - at) for k, p in zip(found[1], found[3]) if at <= p <= at + 5})
        assert kept[0] & kept[1]
