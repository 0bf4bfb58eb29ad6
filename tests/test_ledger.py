"""Accounting on logs worked by hand; sources; expressions on small rows."""

import pytest
from pyspark.sql import functions as F

from ledgerspark.config import LedgerConfig
from ledgerspark.functions import scalars as S
from ledgerspark.functions.diff import complexity, too_complex
from ledgerspark.operators import ledger as L
from ledgerspark.sources import streams

def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def with_contents(pairs, versions):
    old = versions.select("file_no", F.col("rev").alias("old_rev"), F.col("content").alias("old"))
    return pairs.join(versions, ["file_no", "rev"]).join(old, ["file_no", "old_rev"])


def test_delta_accounting(spark):
    """A log worked by hand: a first read, an unchanged one, a delta of one line of 200, a
    rewrite that is told in full, and a read after an edit."""
    body = [f"value_{i} = {i}\n" for i in range(200)]
    texts = ["".join(body), "".join([*body[:100], "value_100 = 0\n", *body[101:]]), "".join(f"other_{i}\n" for i in range(200))]
    versions = spark.createDataFrame([(0, r, t) for r, t in enumerate(texts)], "file_no long, rev int, content string").withColumn("n_lines", S.line_count(F.col("content")))
    plan = [("read", 0), ("read", 0), ("read", 1), ("read", 2), ("edit", 0), ("read", 0)]
    log = spark.createDataFrame([(i, "s", i * 10, kind, "f", 0, rev) for i, (kind, rev) in enumerate(plan)], "action_id long, session_id string, occurred_at long, kind string, file_path string, file_no long, rev int")
    log = log.join(versions.select("file_no", "rev", S.content_hash(F.col("content")).alias("content_hash"), S.token_estimate(F.col("content")).alias("tokens_full"), F.octet_length("content").cast("long").alias("n_bytes")), ["file_no", "rev"])
    def accounts(config):
        told = L.classified(log, config)
        return {r.action_id: r for r in L.accounting(told, L.diff_sizes(with_contents(L.changed_pairs(told), versions), config), config).collect()}

    rows = accounts(LedgerConfig(certificates=False))
    full = [(len(t) + 3) // 4 for t in texts]
    diff = "--- f (last read)\n+++ f (current)\n@@ -98,7 +98,7 @@\n" + "".join(f" {x}" for x in body[97:100]) + "-value_100 = 100\n+value_100 = 0\n" + "".join(f" {x}" for x in body[101:104])
    header = lambda kind, rev: len(f"[ledger: {kind} f {full[rev]} tokens]\n")
    assert [rows[i].outcome for i in (0, 1, 2, 3, 5)] == ["first", "unchanged", "delta", "fallback", "passthrough"]
    assert [rows[i].charged_sent for i in (0, 1, 2, 3, 5)] == [(header("first", 0) + len(texts[0]) + 3) // 4, (header("unchanged", 0) + 3) // 4, (header("delta", 1) + len(diff) + 3) // 4, full[2], full[0]]
    assert rows[2].charged_sent * 5 < full[1] and rows[5].logged_sent == 0
    # the edit is confirmed within its window, and not beyond it
    body = "[ledger: edit confirmed f]\n" + 12 * "0" + " -> " + 12 * "0" + "\nlines 1-200\n"
    for config, outcome, sent in ((LedgerConfig(), "certificate", (len(body) + 3) // 4), (LedgerConfig(cert_window_seconds=9), "passthrough", full[0])):
        row = accounts(config)[5]
        assert (row.outcome, row.charged_full, row.charged_sent) == (outcome, full[0], sent)


def test_a_certificate_dearer_than_its_text(spark):
    """Then the text is told in full."""
    versions = spark.createDataFrame([(0, 0, "a\n"), (0, 1, "b\n")], "file_no long, rev int, content string").withColumn("n_lines", S.line_count(F.col("content")))
    log = [(1, "s", 1, "read", "f", 0, 0, "x", 1, 2), (2, "s", 2, "edit", "f", 0, 1, "y", 1, 2), (3, "s", 3, "read", "f", 0, 1, "y", 1, 2)]
    told = L.classified(spark.createDataFrame(log, "action_id long, session_id string, occurred_at long, kind string, file_path string, file_no long, rev int, content_hash string, tokens_full long, n_bytes long"))
    rows = {r.action_id: r for r in L.accounting(told, L.diff_sizes(with_contents(L.changed_pairs(told), versions))).collect()}
    assert (rows[3].outcome, rows[3].charged_sent, rows[3].logged_sent) == ("fallback", 1, 1)


def test_first_reads_as_outlines(spark):
    """A first read is told the outline where that is cheaper than the text, of a large file too;
    without one a large file is told in full."""
    log = [(1, "a", 1, "read", "f", 0, 0, "x", 100, 400), (2, "a", 2, "read", "f", 0, 0, "x", 100, 400), (3, "a", 3, "read", "g", 1, 0, "y", 100, 400), (4, "a", 4, "read", "h", 2, 0, "z", 50_000, 200_000), (5, "a", 5, "read", "i", 3, 0, "w", 50_000, 200_000)]
    told = L.classified(spark.createDataFrame(log, "action_id long, session_id string, occurred_at long, kind string, file_path string, file_no long, rev int, content_hash string, tokens_full long, n_bytes long"))
    none = spark.createDataFrame([], "file_no long, old_rev int, rev int, diff_bytes long, too_complex boolean, certificate_bytes long")
    outlines = spark.createDataFrame([(0, 0, 200), (1, 0, 399), (2, 0, 5000)], "file_no long, rev int, outline_bytes long")
    rows = {r.action_id: (r.outcome, r.reason, r.charged_full, r.charged_sent) for r in L.accounting(told, none, outlines=outlines).collect()}
    header = lambda kind, path, tokens: len(f"[ledger: {kind} {path} {tokens} tokens]\n")
    assert rows == {
        1: ("first-compressed", None, 100, (header("first-compressed", "f", 100) + 200 + 3) // 4), 2: ("unchanged", None, 100, (header("unchanged", "f", 100) + 3) // 4),
        3: ("first", None, 100, (header("first", "g", 100) + 400 + 3) // 4), 4: ("first-compressed", None, 50_000, (header("first-compressed", "h", 50_000) + 5000 + 3) // 4),
        5: ("fallback", "large_file", 50_000, 50_000),
    }


def test_last_sight(spark):
    """Across blocks of days as one window over the file would have it."""
    import random

    rng = random.Random(1)
    log = [(i, rng.randint(0, 10 * 86_400), f"f{rng.choice((0, 0, 0, 1, 2))}", f"h{rng.randint(0, 3)}") for i in range(400)]
    df = spark.createDataFrame(log, "action_id long, occurred_at long, file_path string, content_hash string")
    last, want = {}, {}
    for i, _, path, h in sorted(log, key=lambda r: (r[1], r[0])):
        want[i], last[path] = last.get(path), h
    assert {r.action_id: r.known_content_hash for r in L.last_sight(df, ["content_hash"]).collect()} == want


def test_json_sink_and_change_stream(spark, tmp_path):
    """Reports as JSON lines; repeated changes of a path within the watermark come once."""
    streams.write_json(spark.createDataFrame([(1, "x"), (2, None)], "n long, s string"), str(tmp_path / "out"))
    assert sorted((r.n, r.s) for r in spark.read.schema("n long, s string").json(str(tmp_path / "out")).collect()) == [(1, "x"), (2, None)]
    rows = [("a", 100), ("a", 101), ("b", 102), ("a", 103)]
    spark.createDataFrame(rows, "path string, at long").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("path string, at long").parquet(str(tmp_path / "in"))
    out = streams.change_stream(source.select("path", F.timestamp_seconds("at").alias("changed_at")))
    query = out.writeStream.format("memory").queryName("changes").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.path for r in spark.table("changes").collect()) == ["a", "b"]


def test_null_texts(spark):
    """Kernels over nulls give nulls, or nothing."""
    from ledgerspark.functions import diff

    df = spark.createDataFrame([(None, "a"), ("a", None), (None, None)], "a string, b string")
    assert [r.x for r in df.select(diff.diff_of(F.lit("f"), "a", "b").alias("x")).collect()] == [None] * 3


def test_binary_source(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"PNG\0\x89\x00abc")
    (tmp_path / "b.txt").write_text("alpha\nbeta\n")
    (tmp_path / "c.txt").write_bytes(b"x" * 102_401)
    (tmp_path / "d.txt").write_bytes(b"\xff\xfe")
    df = streams.binary_files(spark, str(tmp_path)).select(S.basename(F.col("path")).alias("n"), S.file_kind(F.col("content")).alias("k"))
    assert {r.n: r.k for r in df.collect()} == {"a.bin": "binary", "b.txt": "text", "c.txt": "too_large", "d.txt": "binary"}


@pytest.mark.parametrize(("full", "sent", "want"), [(0, 5, 0), (100, 40, 60), (200, 1, 100), (1000, 995, 1), (10, 20, 0)])
def test_percent(spark, full, sent, want):
    assert one(spark, S.percent_saved(F.lit(full), F.lit(sent))) == want


@pytest.mark.parametrize(("old", "new", "want"), [(100, 40, True), (100, 60, False), (0, 0, False), (100, 50, False)])
def test_truncated(spark, old, new, want):
    assert one(spark, S.is_truncated(F.lit(old), F.lit(new))) is want


@pytest.mark.parametrize("text", ["", "a", "aé漢🙂" * 9, "é" * 20])
def test_utf8_cut(spark, text):
    for limit in range(1, 12):
        whole = text.encode()[:limit].decode(errors="ignore")
        want = text if len(text.encode()) <= limit else whole + "~"
        assert one(spark, S.utf8_cut(F.lit(text), limit, "~")) == want


def test_window_keeps_the_last_feed(spark):
    cut = lambda t, a, n: one(spark, S.window(F.lit(t), F.lit(a), F.lit(n)))
    assert cut("a\nb\nc\n", 2, 2) == "b\nc\n" and cut("a\nb\nc", 2, 2) == "b\nc" and cut("a\nb\nc", 1, 2) == "a\nb\n" and cut("a", 3, 1) == ""


def test_complexity(spark):
    diff = "--- f\n+++ f\n@@ -1,2 +1,2 @@\n-a\n+b\n@@ -300 +300,2 @@\n+c\n"
    c = complexity(F.lit(diff), F.lit(10))
    assert one(spark, c).asDict() == {"hunks": 2, "added": 2, "removed": 1, "changed_pct": pytest.approx(0.3), "span": 299}
    assert one(spark, too_complex(c)) is False
    assert one(spark, too_complex(complexity(F.lit(diff), F.lit(5)))) is True


def test_labels(spark):
    assert one(spark, S.git_branch(F.lit("ref: refs/heads/a/b\n"))) == "a/b"
    assert one(spark, S.git_branch(F.lit("0123456789abcdef"))) == "01234567"
    assert one(spark, S.git_branch(F.lit("x"))) is None
    assert one(spark, S.line_argument(F.lit("L12"))) == 12 and one(spark, S.line_argument(F.lit("x"))) is None
    assert one(spark, S.fallback_label(F.lit("binary"))) == "binary file"
    assert one(spark, S.storage_route(F.lit("x" * 99), -1)) == "inline"


def test_additive_migration(spark):
    old, new = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2, "x")], "a int, b string")
    assert sorted(map(tuple, streams.with_columns_of(old, new).collect())) == [(1, None), (2, "x")]


def test_orphans_are_idle_for_three_days(spark):
    """Sessions that were active within three days are kept with all their actions."""
    from ledgerspark.plans import ledger as P
    from ledgerspark.plans import registry

    d = "/root/testdata/sf0.01"
    want = P.plain_actions(spark, d).groupBy("session_id").agg(F.count("*").alias("n"), F.max("occurred_at").alias("at")).where(F.col("at") >= P.NOW - 3 * 86_400)
    got = {r.session_id: r.kept for r in registry.queries()["orphan_anti"](spark, d).collect()}
    assert got == {r.session_id: r.n for r in want.collect()} and len(got) > 9


def test_replies_read_the_log_once(spark):
    """What other sessions saw comes from the log that was classified and written."""
    from ledgerspark.plans import registry

    df = registry.queries()["rendered_replies"](spark, "/root/testdata/sf0.001")
    assert not [x for x in df.inputFiles() if "events" in x] and [x for x in df.inputFiles() if "documents" in x]
