"""The state machine in a stream, in batch and row by row; running aggregates in blocks."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerspark.config import LedgerConfig
from ledgerspark.functions import scalars as S
from ledgerspark.operators import ledger as L
from ledgerspark.operators import scans
from ledgerspark.operators import windows as V
from ledgerspark.sources import streams
from ledgerspark.sources.tables import actions
from ledgerspark.streaming import machine as M

DIR = "/root/testdata/sf0.001"


def random_log(seed, n, sessions="ab"):
    """All kinds of actions on two files of three contents, with idle gaps and windows."""
    rng, rows, at = random.Random(seed), [], 1000
    for i in range(n):
        at += rng.choice([0, 1, 5, 60, 60, 300, 9000 if rng.random() < 0.1 else 30])
        kind = rng.choice(["read", "partial", "partial", "partial", "edit", "reset" if rng.random() < 0.2 else "partial", "delete" if rng.random() < 0.2 else "read"])
        v, first = rng.randint(0, 2), rng.randint(0, 20)
        rows.append((i, rng.choice(sessions), at, kind, rng.choice("fg"), f"h{v}", 100 + v * 150, [10, 18, 30][v], first, first + rng.randint(-1, 9)))
    return rows


def plain(rows, config=LedgerConfig()):
    """The machine, one action after the other."""

    class Row:
        def __init__(self, r):
            for f, x in zip(streams.ACTION_SCHEMA.fieldNames(), r):
                setattr(self, f, x)

    files, last, out = {}, {}, {}
    for a in sorted(map(Row, rows), key=lambda a: (a.occurred_at, a.action_id)):
        if a.occurred_at - last.get(a.session_id, a.occurred_at) > config.ttl or a.kind == "reset":
            files = {k: v for k, v in files.items() if k[0] != a.session_id}
        last[a.session_id] = a.occurred_at
        if a.kind == "reset":
            out[a.action_id] = "reset"
            continue
        key = a.session_id, a.file_path
        files[key], out[a.action_id] = M.step(files.get(key), a)
    return out


def outcomes(df):
    return {r.action_id: r.outcome for r in df.collect()}


def run(spark, tmp_path, name, waves, config=LedgerConfig(), watermark="10 minutes", restart=False):
    """Each wave is a file and a batch; with ``restart`` the query is stopped and begun anew
    after each."""
    (tmp_path / "in").mkdir()
    out, progress = M.stream(streams.action_stream(spark, str(tmp_path / "in")), watermark, config), []
    start = lambda: out.writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    query = None
    for rows in waves:
        spark.createDataFrame(rows, streams.ACTION_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if query is None:
            query = start()
        query.processAllAvailable()
        progress.append([p for p in query.recentProgress if p["stateOperators"]])
        if restart:
            query.stop()
            query = None
    if query is not None:
        query.stop()
    return spark.read.parquet(str(tmp_path / "out")), progress


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    rows = random_log(1, 450)
    got, _ = run(spark, tmp_path, "restarts", [rows[:150], rows[150:300], rows[300:]], restart=True)
    log = spark.createDataFrame(rows, streams.ACTION_SCHEMA)
    want = plain(rows)
    assert outcomes(got) == outcomes(V.machine(log)) == want
    assert set(want.values()) == {"first", "unchanged", "delta", "fallback", "passthrough", "edit", "reset", "deleted", "gone", "partial-silent", "partial-external", "partial-uncovered", "partial-unchanged"}
    # told once: the first action after an idle gap that isn't longer than the tombstone's time
    at = {r[0]: r for r in rows}
    told = {r.action_id for r in got.where("notice").collect()}
    last, gaps = {}, set()
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        if 7200 < r[2] - last.get(r[1], r[2]) <= 7200 + 86_400:
            gaps.add(r[0])
        last[r[1]] = r[2]
    assert told == gaps and told and all(at[i] for i in told)


def test_late_actions_change_nothing(spark, tmp_path):
    rows = random_log(2, 120)
    late = [(1000 + i, *r[1:2], 1001 + i, *r[3:]) for i, r in enumerate(rows[:6])]
    got, _ = run(spark, tmp_path, "late", [rows[:60], late, rows[60:]], watermark="10 days")
    found = outcomes(got)
    assert {k: v for k, v in found.items() if k < 1000} == plain(rows)
    assert {v for k, v in found.items() if k >= 1000} == {"late"}


def test_stream_forgets_idle_sessions(spark, tmp_path):
    """State of files leaves once the watermark is past their session's idle limit, of the
    session after the tombstone's time; what comes behind the watermark is dropped and counted."""
    row = lambda i, session, at: (i, session, at, "read", "f", "h", 10, 2, 1, 2)
    waves = [[row(1, "a", 1000), row(2, "b", 1100)], [row(3, "b", 20_000)], [row(4, "c", 40_000), row(5, "a", 40_100)], [row(6, "a", 2000), row(7, "c", 40_200)]]
    got, progress = run(spark, tmp_path, "idle", waves, LedgerConfig(tombstone_seconds=0), "1 second")
    assert outcomes(got) == {1: "first", 2: "first", 3: "first", 4: "first", 5: "first", 7: "unchanged"}
    assert all(op["numRowsTotal"] <= 6 for batches in progress for p in batches for op in p["stateOperators"])
    # of two sessions that are live at the end: a value and a timer's rows each, no more than after the first batch
    assert [op["numRowsTotal"] for op in progress[-1][-1]["stateOperators"]] == [op["numRowsTotal"] for op in progress[0][-1]["stateOperators"]]
    assert sum(op["numRowsDroppedByWatermark"] for p in progress[-1] for op in p["stateOperators"]) >= 1


@pytest.mark.parametrize("seed", range(3))
def test_batch_equals_plain(spark, seed):
    rows = random_log(10 + seed, 1200, "abc")
    assert outcomes(V.machine(spark.createDataFrame(rows, streams.ACTION_SCHEMA).repartition(3))) == plain(rows)


def test_batch_without_partials_equals_classified(spark):
    log = actions(spark, DIR).where("kind <> 'partial'")
    a = outcomes(L.classified(log))
    b = {k: v for k, v in outcomes(V.machine(log)).items() if v != "reset"}
    assert a == b and set(a.values()) >= {"first", "edit"}


def test_classified_knows_deletes(spark):
    rows = [(1, "read", "h"), (2, "delete", None), (3, "read", "h"), (4, "read", "h"), (5, "edit", "i"), (6, "delete", None), (7, "delete", None), (8, "read", "i")]
    log = [(i, "s", 10 * i, kind, "f", h, 9, 1) for i, kind, h in rows]
    df = spark.createDataFrame(log, "action_id long, session_id string, occurred_at long, kind string, file_path string, content_hash string, n_bytes long, rev int")
    assert outcomes(L.classified(df)) == {1: "first", 2: "deleted", 3: "first", 4: "unchanged", 5: "edit", 6: "deleted", 7: "gone", 8: "first"}


def test_a_hot_session_in_blocks(spark):
    """One session holds nearly all of a log: it is cut by time, and every result is the same."""
    rows = random_log(5, 3000, "aaaaaaaaab")
    log = spark.createDataFrame(rows, streams.ACTION_SCHEMA)
    cut = scans.spread(log, ["session_id"], most=1000, seconds=600)
    assert "block" not in scans.spread(log, ["session_id"]).columns
    sizes = [r["count"] for r in cut.where("session_id = 'a'").groupBy("block").count().collect()]
    assert len(sizes) > 50 and max(sizes) < 100 and cut.where("session_id = 'b' and block is not null").isEmpty()
    same = lambda f, *columns: sorted(map(str, f(cut).select(*columns).collect())) == sorted(map(str, f(log).select(*columns).collect()))
    assert same(L.segments, "action_id", "gap", "incarnation", "epoch")
    assert same(V.machine, "action_id", "outcome")
    revised = lambda df: L.classified(df.withColumn("rev", F.substring("content_hash", 2, 1).cast("int")))
    assert same(revised, "action_id", "outcome", "prev_hash", "edit_old", "edit_rev")
    assert outcomes(V.machine(cut)) == plain(rows)


def test_running_with_null_keys_and_empty_blocks(spark):
    rows = [(i, None if i % 7 == 0 else f"k{i % 2}", i * 10, None if i % 3 else i) for i in range(200)]
    df = spark.createDataFrame(rows, "action_id long, k string, occurred_at long, v long")
    aggregates = {"sums": {"s": F.col("v")}, "lasts": {"l": F.col("v")}, "ors": {"o": F.col("v")}}
    want = scans.running(df, ["k"], L.ORDER, **aggregates)
    got = scans.running(df.withColumn("block", F.when(F.col("k") != "k1", F.expr("occurred_at div 130"))), ["k"], L.ORDER, **aggregates)
    columns = ["action_id", "s", "l", "o"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    empty = df.limit(0).withColumn("block", F.lit(1))
    assert scans.running(empty, ["k"], L.ORDER, **aggregates).count() == 0


def test_window_charges_by_hand(spark):
    """A window of lines 5 to 24 of 80: told in full, then a header in its place; a window of
    two short lines costs no more than its header."""
    body = "".join(f"line number {i} of the file\n" for i in range(1, 81))
    log = [(i, "s", i, kind, "f.txt", "h", len(body), 80, a, b) for i, kind, a, b in [(1, "partial", 5, 24), (2, "partial", 5, 24), (3, "partial", 7, 7), (4, "partial", 20, 30), (5, "partial", 5, 30), (6, "read", 1, 1), (7, "partial", 70, 2000)]]
    df = spark.createDataFrame(log, streams.ACTION_SCHEMA).withColumns({"file_no": F.lit(1), "rev": F.lit(0)})
    contents = spark.createDataFrame([(1, 0, body)], "file_no int, rev int, content string")
    found = V.outcomes(df)
    assert outcomes(found.where("kind = 'read'")) == {6: "first"}
    got = {r.action_id: (r.outcome, r.first_line, r.last_line, r.charged_full, r.charged_sent) for r in V.charges(found, contents).collect()}
    tokens = lambda a, b: (len("".join(body.splitlines(True)[a - 1 : b])) + 3) // 4
    header = lambda a, b: (len(f"[ledger: unchanged f.txt, lines {a}-{b}]\n") + 3) // 4
    assert got == {
        1: ("partial-silent", 5, 24, tokens(5, 24), tokens(5, 24)), 2: ("partial-unchanged", 5, 24, tokens(5, 24), header(5, 24)),
        3: ("partial-gated", 7, 7, tokens(7, 7), tokens(7, 7)), 4: ("partial-uncovered", 20, 30, tokens(20, 30), tokens(20, 30)),
        5: ("partial-unchanged", 5, 30, tokens(5, 30), header(5, 30)), 7: ("partial-unchanged", 70, 80, tokens(70, 80), header(70, 80)),
    }


def test_sizes_of_lines_tell_a_window(spark):
    texts = ["", "\n", "a", "a\n", "a\nb", "é\n\nb\n", "\n\n", "one\ntwo\nthree", None]
    rows = [(t, s, n) for t in texts for s in range(1, 6) for n in range(-1, 6)]
    df = spark.createDataFrame(rows, "t string, s int, n int")
    sizes = S.window_bytes(S.line_bytes(F.col("t")), F.col("s"), F.col("n"))
    got = df.select("t", "s", "n", sizes.alias("a"), F.octet_length(S.window(F.col("t"), F.col("s"), F.col("n"))).alias("b")).collect()
    assert [r for r in got if r.a != r.b] == [] and len(got) == len(rows)


def test_no_content_meets_a_window(spark):
    rows = spark.createDataFrame([], "action_id long, kind string, outcome string, file_path string, file_no long, rev int, first_line int, last_line int, win_end int")
    contents = spark.createDataFrame([], "file_no long, rev int, content string")
    plan = V.charges(rows, contents)._jdf.queryExecution().analyzed().toString()
    assert "Join" in plan and "content" not in plan.split("Join")[0]
