"""The state machine over a stream, with typed state by file.

Two operators follow each other. The first is keyed by session and keeps four numbers of it:
when it was last active, when the present run of activity began, how often it was reset. It
numbers each action (``started``, ``epoch``), so that no reset and no idle gap has to reach every
file, and marks what comes ``late``: older than its session's last action. The second is keyed by
session and file: a value (the baseline), a list (the line ranges that were seen) and a timer. State
of another ``started`` or ``epoch`` is as good as none. So a session of very many actions is as
many tasks' work as it has files.

A session that is idle for the TTL of event time has lost its files; it is remembered for the
tombstone's time, and its next action within that carries the ``notice``, once. Rows behind the
watermark are dropped and counted by Spark. The batch form of the same is
:func:`ledgerspark.operators.windows.machine`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import DEFAULT, LedgerConfig

OUT = "action_id long, session_id string, file_path string, outcome string, notice boolean"
COLUMNS = ["action_id", "session_id", "occurred_at", "kind", "file_path", "content_hash", "n_bytes", "n_lines", "win_start", "win_end"]
NUMBERED = (
    "action_id long, session_id string, occurred_at long, kind string, file_path string, content_hash string, n_bytes long, n_lines long, win_start long, win_end long, "
    "started long, epoch long, late boolean, notice boolean, at timestamp"
)
ORDER = ["occurred_at", "action_id"]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def merge(ranges: list[list[int]]) -> list[list[int]]:
    """Inclusive ranges in order, joined where they overlap or touch; invalid ones dropped."""
    out: list[list[int]] = []
    for a, b in sorted([a, b] for a, b in ranges if 1 <= a <= b):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def covers(ranges: list[list[int]], first: int, last: int) -> bool:
    """Whether merged ranges hold a range; an invalid one is held by none."""
    return 1 <= first <= last and any(a <= first and last <= b for a, b in ranges)


@dataclass
class Known:
    """What a session knows of a file."""

    hash: str
    bytes: int
    lines: int
    last_kind: str = ""
    seen: list[list[int]] = field(default_factory=list)


def step(have: Known | None, a) -> tuple[Known | None, str]:
    """What is known after an action on a file (``kind, content_hash, n_bytes, n_lines,
    win_start, win_end``), and its outcome."""
    if a.kind == "delete":
        return None, "deleted" if have else "gone"
    now = Known(a.content_hash, int(a.n_bytes), int(a.n_lines))
    if a.kind == "edit":
        now.last_kind, now.seen = "edit", have.seen if have else []
        return now, "edit"
    if a.kind == "partial":
        first = max(int(a.win_start), 1)
        last = min(int(a.win_end), max(now.lines, have.lines if have else 0, first))
        if have is None:
            now.seen = merge([[first, last]])
            return now, "partial-silent"
        now.last_kind = have.last_kind
        if have.hash != now.hash:
            now.seen = merge([[first, last]])
            return now, "partial-external"
        known = covers(have.seen, first, last)
        now.seen = have.seen if known else merge([*have.seen, [first, last]])
        return now, "partial-unchanged" if known else "partial-uncovered"
    now.last_kind, now.seen = "read", merge([[1, now.lines]])
    if have is None:
        return now, "first"
    if have.last_kind == "edit":
        return now, "passthrough"
    if have.lines and not covers(have.seen, 1, have.lines):
        return now, "first"
    if have.hash == now.hash:
        return now, "unchanged"
    return now, "fallback" if have.bytes > 0 and now.bytes * 2 < have.bytes else "delta"


def _timer(handle: StatefulProcessorHandle, when: int) -> None:
    """One timer a key, in milliseconds of event time."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
    handle.registerTimer(when)


class Sessions(StatefulProcessor):
    """Numbers a session's actions; its state is one row."""

    def __init__(self, config: LedgerConfig):
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "occurred_at long, action_id long, started long, epoch long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(ORDER, ignore_index=True)
        at, ids, ttl = pdf["occurred_at"].to_numpy(np.int64), pdf["action_id"].to_numpy(np.int64), self.config.ttl
        held = self.last.get() if self.last.exists() else None
        last_at, last_id, started, epoch = held if held else (int(at[0]), -1, int(at[0]), 0)
        late = (at < last_at) | ((at == last_at) & (ids < last_id)) if held else np.zeros(len(at), bool)
        n = int(late.sum())  # rows are in order, so these come first
        gap = np.diff(at[n:], prepend=last_at)
        starts = np.where(gap > ttl, at[n:], np.int64(-1))
        # the last start so far, by position
        where = np.maximum.accumulate(np.where(starts >= 0, np.arange(len(starts)), -1))
        began = np.where(where >= 0, starts[np.maximum(where, 0)], started)
        epochs = epoch + np.cumsum((pdf["kind"].to_numpy()[n:] == "reset").astype(np.int64))
        pad = np.zeros(n, np.int64)
        pdf["started"], pdf["epoch"], pdf["late"] = np.concatenate([pad, began]), np.concatenate([pad, epochs]), late
        pdf["notice"] = np.concatenate([pad > 0, (gap > ttl) & (gap <= ttl + self.config.tombstone_seconds)])
        if n < len(at):
            self.last.update((int(at[-1]), int(ids[-1]), int(began[-1]), int(epochs[-1])))
            _timer(self.handle, (int(at[-1]) + ttl + self.config.tombstone_seconds) * 1000)
        yield pdf[[x.split()[0] for x in NUMBERED.split(", ")]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


class Files(StatefulProcessor):
    """What a session knows of a file: a value, a list of ranges and a timer."""

    def __init__(self, config: LedgerConfig):
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.base = handle.getValueState("base", "started long, epoch long, hash string, bytes long, lines long, last_kind string")
        self.seen = handle.getListState("seen", "first long, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(ORDER)
        have, segment = None, None
        if self.base.exists():
            started, epoch, *value = self.base.get()
            have, segment = Known(*value, [[a, b] for a, b in self.seen.get()]), (started, epoch)
        before, out = (have, segment), []
        for a in pdf.itertuples():
            if a.late or a.kind == "reset":
                out.append("late" if a.late else "reset")
                continue
            if segment != (a.started, a.epoch):
                have, segment = None, (a.started, a.epoch)
            have, outcome = step(have, a)
            out.append(outcome)
        if have is None:
            self.base.clear()
            self.seen.clear()
        elif (have, segment) != before or not all(x in ("late", "reset") for x in out):
            self.base.update((*(int(x) for x in segment), have.hash, have.bytes, have.lines, have.last_kind))
            if have.seen:
                self.seen.put([(int(a), int(b)) for a, b in have.seen])
            else:
                self.seen.clear()
            _timer(self.handle, (int(pdf["occurred_at"].max()) + self.config.ttl) * 1000)
        yield pd.DataFrame({"action_id": pdf["action_id"].values, "session_id": pdf["session_id"].values, "file_path": pdf["file_path"].values, "outcome": out, "notice": pdf["notice"].values})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.base.clear()
        self.seen.clear()
        yield from ()

    def close(self) -> None:
        pass


def stream(actions: DataFrame, watermark: str = "10 minutes", config: LedgerConfig = DEFAULT) -> DataFrame:
    """``OUT`` of a streaming log (COLUMNS), in append mode. Typed state needs the RocksDB store,
    which is set for the session if it has the default one."""
    spark, store = actions.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(store):
        spark.conf.set(store, ROCKS)
    timed = actions.select(*COLUMNS, F.timestamp_seconds("occurred_at").alias("at")).withWatermark("at", watermark)
    numbered = timed.groupBy("session_id").transformWithStateInPandas(Sessions(config), NUMBERED, "Append", "EventTime", eventTimeColumnName="at")
    return numbered.groupBy("session_id", "file_path").transformWithStateInPandas(Files(config), OUT, "Append", "EventTime")
