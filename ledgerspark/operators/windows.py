"""Reads of line windows, and what they make of full reads (the batch form).

Of a file a session knows a baseline (the content of its last action on it, be it a full read,
an edit or a window) and the lines it has seen of it. Every action leaves its own content as
the baseline. A full read has shown all lines; a window of a file that isn't known
(``silent``) or has changed since (``external``) begins a new set of seen lines with its own;
any other window adds to the set that there is, and an edit leaves it. So a set is a group of
actions that begins at one of those, and whether a window is covered asks for the union of the
*earlier* windows of its group only.

That is answered in blocks of 64 lines: each window becomes a mask a block, a running bitwise
or by group and block is what was seen before, and a window is covered if none of its masks has
a bit besides. Lines that the group's full read has shown need no mask. Nothing is merged and
no pair of windows meets; the work is a window's lines / 64, in as many keys as there are
blocks, and hot keys are cut by time (:mod:`scans`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, LedgerConfig
from ..functions import render
from ..functions import scalars as S
from .ledger import FILE, ORDER, segments
from .scans import running

LINES = 64


def mask(first: Column, last: Column, slot: Column) -> Column:
    """The bits of lines ``first`` to ``last`` that lie in block ``slot``."""
    low, high = F.greatest(first - slot * LINES, F.lit(0)).cast("int"), F.least(last - slot * LINES, F.lit(LINES - 1)).cast("int")
    ones = F.lit(-1).cast("long")
    return F.call_function("shiftleft", ones, low).bitwiseAND(F.call_function("shiftrightunsigned", ones, F.lit(LINES - 1).cast("int") - high))


def grouped(actions: DataFrame, config: LedgerConfig = DEFAULT) -> DataFrame:
    """Reads, windows, edits and deletes, with the baseline before each (``known``), the last
    action but windows (``last_kind``), which group of seen lines it looks at (``seen_group``)
    or adds to, and the lines to look for or to add, ``first_line`` to ``last_line``."""
    rows = segments(actions, config).where("kind in ('read', 'edit', 'partial', 'delete')")
    kept = F.struct(*(F.when(F.col("kind") != "delete", F.col(c)).alias(k) for k, c in (("hash", "content_hash"), ("lines", "n_lines"), ("bytes", "n_bytes"))))
    rows = running(rows, FILE, ORDER, lasts={"known": kept, "last_kind": F.when(F.col("kind") != "partial", F.col("kind"))})
    partial, read = F.col("kind") == "partial", F.col("kind") == "read"
    fresh = F.col("known.hash").isNull() | (F.col("known.hash") != F.col("content_hash"))
    begins = read | (F.col("kind") == "delete") | (partial & fresh)
    rows = rows.withColumn("begins", begins)
    start = F.when(F.col("begins"), F.struct("kind", F.col("n_lines").alias("lines")))
    rows = running(rows, FILE, ORDER, sums={"group": F.col("begins").cast("long")}, lasts={"start": start})
    shown = F.when(F.col("start.kind") == "read", F.col("start.lines")).otherwise(0)
    first = F.greatest("win_start", F.lit(1))
    last = F.least("win_end", F.greatest("n_lines", F.coalesce("known.lines", F.lit(0)), first))
    adds = partial & F.col("begins")
    return rows.withColumns({
        "first_line": F.when(partial, first), "last_line": F.when(partial, last),
        "seen_group": F.when(read, F.col("group") - 1).otherwise(F.col("group")),
        "low": F.when(adds, first).when(partial, F.greatest(first, shown + 1)).when(read, shown + 1),
        "high": F.when(partial, last).when(read, F.col("known.lines")),
    })


def uncovered(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and ``open`` of :func:`grouped`'s rows: whether some line from ``low`` to ``high``
    wasn't seen by an earlier window of the group."""
    some = F.when(F.col("low") <= F.col("high"), F.sequence(F.call_function("div", F.col("low"), F.lit(LINES)), F.call_function("div", F.col("high"), F.lit(LINES))))
    block = ["block"] if "block" in rows.columns else []
    cells = rows.select(
        *FILE, *ORDER, "kind", "seen_group", "low", "high", *block, F.struct(*keep).alias("own"), F.explode_outer(some).alias("slot")
    )
    cells = cells.withColumn("mask", F.when(F.col("slot").isNotNull(), mask(F.col("low"), F.col("high"), F.col("slot"))))
    adds = F.when(F.col("kind") == "partial", F.col("mask"))
    cells = running(cells, [*FILE, "seen_group", "slot"], ORDER, ors={"seen": adds})
    new = F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0).cast("long")))) != 0
    one = cells.groupBy("action_id").agg(F.first("own").alias("own"), F.coalesce(F.max(new), F.lit(False)).alias("open"))
    return one.select("own.*", "open")


def outcomes(actions: DataFrame, config: LedgerConfig = DEFAULT) -> DataFrame:
    """``action_id, session_id, file_path, outcome`` of every action but resets, and what
    charges need.

    A full read of a file of which only windows were seen, and not all of them, is a ``first``
    one. A window is ``partial-silent``, ``partial-external``, ``partial-uncovered`` (also one
    that ends before it begins) or ``partial-unchanged``; only of the last is anything left out."""
    keep = ["action_id", "session_id", "file_path", "occurred_at", "file_no", "rev", "kind", "content_hash", "n_bytes", "n_lines", "first_line", "last_line", "win_end", "known", "last_kind"]
    rows = uncovered(grouped(actions, config), [c for c in keep if c in actions.columns or c not in ("file_no", "rev")])
    new, changed = F.col("known.hash").isNull(), F.col("known.hash") != F.col("content_hash")
    open_ = F.col("open") | (F.col("first_line") > F.col("last_line"))
    window = F.when(new, "partial-silent").when(changed, "partial-external").when(open_, "partial-uncovered").otherwise("partial-unchanged")
    full = (
        F.when(new, "first").when(F.col("last_kind") == "edit", "passthrough").when(F.col("open"), "first").when(~changed, "unchanged")
        .when((F.col("known.bytes") > 0) & (F.col("n_bytes") * 2 < F.col("known.bytes")), "fallback").otherwise("delta")
    )
    kind, gone = F.col("kind"), F.when(new, "gone").otherwise("deleted")
    return rows.withColumn("outcome", F.when(kind == "read", full).when(kind == "partial", window).when(kind == "delete", gone).otherwise(kind))


def machine(actions: DataFrame, config: LedgerConfig = DEFAULT) -> DataFrame:
    """``action_id, session_id, file_path, outcome`` of every action: what the streaming machine
    (:mod:`streaming.machine`) says of the same log in order."""
    columns = ["action_id", "session_id", "file_path", "outcome"]
    resets = actions.where("kind = 'reset'").select("action_id", "session_id", "file_path", F.lit("reset").alias("outcome"))
    return outcomes(actions, config).select(*columns).unionByName(resets.select(*columns))


def charges(rows: DataFrame, contents: DataFrame, config: LedgerConfig = DEFAULT) -> DataFrame:
    """``action_id, outcome, first_line, last_line, charged_full, charged_sent`` of windows.

    A window is charged its own text, not the file's; one that is ``partial-unchanged`` is sent
    a header in place of it, unless that costs as much (``partial-gated``). ``contents`` has
    ``file_no, rev, content``; of a content only its lines' sizes meet the windows."""
    text = contents.select("file_no", "rev", S.line_bytes(F.col("content")).alias("sizes"))
    own = rows.where("kind = 'partial'").select("action_id", "outcome", "file_path", "file_no", "rev", "first_line", "last_line", "win_end").join(text, ["file_no", "rev"])
    part = S.window_bytes(F.col("sizes"), F.col("first_line"), F.col("win_end") - F.col("first_line") + 1)
    own = own.select("action_id", "outcome", "file_path", "first_line", "last_line", F.call_function("div", part + 3, F.lit(4)).alias("charged_full"))
    sent = S.token_estimate(render.window_unchanged(F.col("file_path"), F.col("first_line"), F.col("last_line"), config))
    known, gated = F.col("outcome") == "partial-unchanged", sent >= F.col("charged_full")
    return own.select(
        "action_id", F.when(known & gated, "partial-gated").otherwise(F.col("outcome")).alias("outcome"), "first_line", "last_line",
        "charged_full", F.when(known & ~gated, sent).otherwise(F.col("charged_full")).alias("charged_sent"),
    )
