"""The batch ledger: what each action delivered, by windows over (session, segment, file).

Two orderings matter and both are partitioned: by session (idle gaps, resets) and by
session, segment and file (baselines). Contents stay out of the shuffles; hashes and sizes
carry the decisions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import DEFAULT, LedgerConfig
from ..functions import diff as D
from ..functions import render
from ..functions import scalars as S
from .scans import running

ORDER = ("occurred_at", "action_id")


FILE = ["session_id", "incarnation", "epoch", "file_path"]


def segments(actions: DataFrame, config: LedgerConfig = DEFAULT, ttl: bool = True) -> DataFrame:
    """Adds ``gap, incarnation`` (idle for longer than the TTL begins a new one) and
    ``epoch`` (resets so far); baselines don't outlive either. Sessions that have a ``block``
    (:func:`scans.spread`) are worked on in blocks."""
    out = running(actions, ["session_id"], ORDER, lasts={"before": F.col("occurred_at")})
    out = out.withColumn("gap", F.col("occurred_at") - F.col("before")).drop("before")
    idle = (F.col("gap") > config.ttl).cast("long") if ttl else F.lit(0).cast("long")
    return running(out, ["session_id"], ORDER, sums={"incarnation": idle, "epoch": (F.col("kind") == "reset").cast("long")})


def _file_window():
    return W.partitionBy(*FILE).orderBy(*ORDER)


def baselines(segmented: DataFrame) -> DataFrame:
    """Adds what the session last received of the file before each action: ``prev_hash``,
    ``prev_rev``, ``prev_bytes``, ``prev_kind`` (the last read or edit; nothing after a delete)."""
    fields = {"hash": "content_hash", "rev": "rev", "bytes": "n_bytes", "kind": "kind"}
    kept = F.struct(*(F.when(F.col("kind") != "delete", F.col(c)).alias(k) for k, c in fields.items()))
    sets = F.when(F.col("kind").isin("read", "edit", "delete"), kept)
    work = running(segmented.where("kind <> 'reset'"), FILE, ORDER, lasts={"prev": sets})
    return work.withColumns({f"prev_{k}": F.col(f"prev.{k}") for k in fields}).drop("prev")


def outcomes(actions: DataFrame, ttl: bool = False) -> DataFrame:
    """Each full read as ``first``, ``unchanged`` or ``delta`` against its baseline of reads."""
    s = segments(actions, ttl=ttl).where("kind = 'read'")
    prev = F.lag("content_hash").over(_file_window())
    kind = F.when(prev.isNull(), "first").when(prev == F.col("content_hash"), "unchanged").otherwise("delta")
    return s.withColumn("outcome", kind)


def outcome_mix(actions: DataFrame) -> DataFrame:
    return outcomes(actions).groupBy("outcome").agg(F.count("*").alias("n"), F.sum("tokens_full").alias("tokens_full"))


def classified(actions: DataFrame, config: LedgerConfig = DEFAULT) -> DataFrame:
    """Reads and edits with ``outcome``: a read right after an edit is a ``passthrough``,
    others are first, unchanged, ``fallback`` (shrunk by over half) or delta. A delete is
    ``deleted``, or ``gone`` if the session knew no such file; the next read is a first one.

    ``edit_old, edit_rev`` are the revisions before and after the edit that a certificate can
    confirm to a passthrough: the newest one since the last reset that left the read's content
    within the window. The file's rows are in place for that, so it costs no shuffle."""
    b = baselines(segments(actions, config))
    read = (
        F.when(F.col("prev_hash").isNull(), "first")
        .when(F.col("prev_kind") == "edit", "passthrough")
        .when(F.col("prev_hash") == F.col("content_hash"), "unchanged")
        .when((F.col("prev_bytes") > 0) & (F.col("n_bytes") * 2 < F.col("prev_bytes")), "fallback")
        .otherwise("delta")
    )
    gone = F.when(F.col("prev_hash").isNull(), "gone").otherwise("deleted")
    b = b.withColumn("outcome", F.when(F.col("kind") == "read", read).when(F.col("kind") == "delete", gone).otherwise(F.col("kind")))
    edit = F.when((F.col("kind") == "edit") & (F.col("prev_hash") != F.col("content_hash")), F.struct("occurred_at", "prev_rev", "rev"))
    b = running(b, [*FILE, "content_hash"], ORDER, lasts={"edit": edit})
    near = (F.col("outcome") == "passthrough") & (F.col("edit.occurred_at") >= F.col("occurred_at") - config.cert_window_seconds) & F.lit(config.certificates)
    return b.withColumns({"edit_old": F.when(near, F.col("edit.prev_rev")), "edit_rev": F.when(near, F.col("edit.rev"))}).drop("edit")


def header(outcome: Column | str, config: LedgerConfig = DEFAULT) -> Column:
    """What stands before a reply; its bytes are sent, so they count."""
    return render.header(outcome, F.col("file_path"), F.col("tokens_full"), config)


def replies(facts: DataFrame, statuses: DataFrame, config: LedgerConfig = DEFAULT) -> DataFrame:
    """``action_id, reply``: what is said of each read besides its text or diff. A first read also
    says what other sessions' sight of the file makes of it, and every reply closes with what
    the session has read and saved so far."""
    told = facts.join(statuses.select("action_id", "status"), "action_id", "left")
    saved = F.col("charged_full") - F.col("charged_sent")
    told = running(told, ["session_id"], ORDER, sums={"reads": F.lit(1).cast("long"), "saved": saved})
    path, outcome = F.col("file_path"), F.col("outcome")
    own = F.when(outcome == "fallback", render.fallback(path, F.col("reason"), config)).when(outcome == "deleted", render.deleted(path, config))
    own = own.when(outcome.isin("first", "unchanged", "delta"), render.header(outcome, path, F.col("charged_full"), config)).otherwise("")
    other = F.when(outcome == "first", render.registry(F.coalesce("status", F.lit("unknown")), config)).otherwise("")
    return told.select("action_id", F.concat(own, other, render.session_segment(F.col("session_id"), F.col("reads"), F.col("saved"))).alias("reply"))


def tokens_of(n_bytes: Column) -> Column:
    return F.call_function("div", n_bytes + 3, F.lit(4))


def _told(classified_: DataFrame) -> DataFrame:
    """Reads, with the revisions that a diff or a certificate lies between: ``old_rev, rev``."""
    reads = classified_.where("kind = 'read'")
    return reads.withColumns({"old_rev": F.coalesce("edit_old", "prev_rev"), "rev": F.coalesce("edit_rev", "rev")})


def changed_pairs(classified_: DataFrame) -> DataFrame:
    """``file_no, old_rev, rev, file_path`` of each change that some read was told or had
    certified, once."""
    told = _told(classified_).where("outcome = 'delta' or edit_rev is not null")
    return told.groupBy("file_no", "old_rev", "rev").agg(F.first("file_path").alias("file_path"))


def diff_sizes(both: DataFrame, config: LedgerConfig = DEFAULT) -> DataFrame:
    """``file_no, old_rev, rev, diff_bytes, too_complex, certificate_bytes``: each pair's diff,
    made once, from :func:`changed_pairs` with both contents, ``old`` and ``content`` (of
    ``n_lines``)."""
    both = both.withColumn("diff", D.diff_of(F.col("file_path"), F.col("old"), F.col("content")))
    size = F.octet_length("diff").cast("long").alias("diff_bytes")
    certificate = render.certificate(F.col("file_path"), S.content_hash(F.col("old")), S.content_hash(F.col("content")), D.ranges_of(F.col("diff")), config)
    return both.select("file_no", "old_rev", "rev", size, F.octet_length(certificate).cast("long").alias("certificate_bytes"), D.too_complex(D.complexity(F.col("diff"), F.col("n_lines")), config).alias("too_complex"))


def accounting(classified_: DataFrame, diffs: DataFrame, config: LedgerConfig = DEFAULT, outlines: DataFrame | None = None) -> DataFrame:
    """``outcome, reason, charged_full, charged_sent, logged_full, logged_sent`` of every read.

    A delta is charged its header and diff. What isn't worth its header, or can't be told short,
    is a ``fallback``, charged in full without a header, for a ``reason``: the text is a
    ``large_file``, it was ``truncated``, its diff is ``too_complex`` or costs as much as the text
    (``diff_bigger``), or a reply of ``unchanged`` or a certificate does (``overhead``). A
    passthrough is charged in full and logged as nothing, unless its edit is certified: then it's
    a ``certificate``, charged that.

    With ``outlines`` (``file_no, rev, outline_bytes``) a first read, of a large file too, is told
    the outline where that is cheaper than the text: it is ``first-compressed``."""
    reads = _told(classified_).join(diffs, ["file_no", "old_rev", "rev"], "left")
    if outlines is None:
        reads = reads.withColumn("outline_bytes", F.lit(None).cast("long"))
    else:
        reads = reads.join(outlines.select("file_no", "rev", "outline_bytes"), ["file_no", "rev"], "left")
    short = (F.col("outcome") == "first") & (tokens_of(F.col("outline_bytes")) < F.col("tokens_full"))
    reads = reads.withColumn("outcome", F.when(short, "first-compressed").otherwise(F.col("outcome")))
    full, told, certified = F.col("tokens_full"), F.col("outcome"), F.col("edit_rev").isNotNull()
    said = lambda kind: tokens_of(F.octet_length(header(kind, config)))
    delta, certificate = tokens_of(F.octet_length(header("delta", config)) + F.col("diff_bytes")), tokens_of(F.col("certificate_bytes"))
    reason = (
        F.when(told.isin("first", "delta", "fallback") & (F.col("n_bytes") > config.text_max_bytes), "large_file").when(told == "fallback", "truncated")
        .when((told == "delta") & F.col("too_complex"), "too_complex").when((told == "delta") & (delta >= full), "diff_bigger")
        .when(certified & (certificate >= full), "overhead").when((told == "unchanged") & (said("unchanged") >= full), "overhead")
    )
    reads = reads.withColumn("reason", reason)
    outcome = F.when(F.col("reason").isNotNull(), "fallback").when(certified, "certificate").otherwise(told)
    reads = reads.withColumn("outcome", outcome)
    sent = (
        F.when(F.col("reason").isNotNull(), full)
        .when(told == "unchanged", said("unchanged"))
        .when(told == "first", tokens_of(F.octet_length(header("first", config)) + F.col("n_bytes")))
        .when(told == "first-compressed", tokens_of(F.octet_length(header("first-compressed", config)) + F.col("outline_bytes")))
        .when(told == "delta", delta)
        .when(told == "certificate", certificate)
        .otherwise(full)
    )
    passed = told == "passthrough"
    return reads.select(
        "action_id", "session_id", "file_path", "occurred_at", "outcome", "reason", "epoch",
        full.alias("charged_full"), sent.alias("charged_sent"),
        F.when(passed, F.lit(0).cast("long")).otherwise(full).alias("logged_full"), F.when(passed, F.lit(0).cast("long")).otherwise(sent).alias("logged_sent"),
    )


def edit_events(actions: DataFrame, config: LedgerConfig = DEFAULT, ttl: bool = True) -> DataFrame:
    """Edits that changed a known baseline: ``edit_id, before_hash, after_hash, edited_at``."""
    b = baselines(segments(actions, config, ttl)).where("kind = 'edit' and prev_hash is not null and prev_hash <> content_hash")
    return b.select("session_id", "file_path", F.col("action_id").alias("edit_id"), F.col("prev_hash").alias("before_hash"), F.col("content_hash").alias("after_hash"), F.col("occurred_at").alias("edited_at"))


def certificates(actions: DataFrame, window_seconds: int, config: LedgerConfig = DEFAULT) -> DataFrame:
    """Reads right after an edit, with the newest edit of the same session and file that
    left this content within the window (ties by the larger edit), or null."""
    reads = baselines(segments(actions, config, ttl=False)).where("kind = 'read' and prev_kind = 'edit'")
    reads = reads.select("action_id", "session_id", "file_path", "occurred_at", "content_hash")
    edits = edit_events(actions, config, ttl=False).withColumnsRenamed({"session_id": "e_session", "file_path": "e_path"})
    match = (
        (reads["session_id"] == edits["e_session"]) & (reads["file_path"] == edits["e_path"]) & (reads["content_hash"] == edits["after_hash"])
        & (edits["edited_at"] >= reads["occurred_at"] - window_seconds) & (edits["edited_at"] <= reads["occurred_at"])
    )
    best = F.max(F.struct("edited_at", "edit_id")).alias("x")
    return reads.join(edits, match, "left").groupBy("action_id").agg(best).select("action_id", F.col("x.edit_id").alias("edit_id"))


def lagged(rows: DataFrame, keys: list[str], order: tuple[str, ...], block: Column, columns: list[str]) -> DataFrame:
    """``rows`` with ``known_<column>``: what the row before of the same keys had.

    A key that holds a third of all rows isn't one task's work: rows are ordered within
    blocks, which follow each other in the order, and the first row of a block takes the last
    one of the block before."""
    rows = rows.withColumn("block", block)
    last = rows.groupBy(*keys, "block").agg(F.max(F.struct(*order, *columns)).alias("x"))
    before = last.withColumn("y", F.lag("x").over(W.partitionBy(*keys).orderBy("block"))).select(*keys, "block", "y")
    w = W.partitionBy(*keys, "block").orderBy(*order)
    inner = rows.withColumns({f"known_{c}": F.lag(c).over(w) for c in columns} | {"first": F.row_number().over(w) == 1})
    out = inner.join(before, [*keys, "block"])
    return out.withColumns({f"known_{c}": F.when(F.col("first"), F.col(f"y.{c}")).otherwise(F.col(f"known_{c}")) for c in columns}).drop("first", "y", "block")


def last_sight(seen: DataFrame, columns: list[str], days: int = 1) -> DataFrame:
    """``seen`` with ``known_<column>``: what the last sight of the same file had, by any
    session."""
    return lagged(seen, ["file_path"], ORDER, F.call_function("div", F.col("occurred_at"), F.lit(86_400 * days)), columns)


def registry_status(actions: DataFrame, config: LedgerConfig = DEFAULT) -> DataFrame:
    """How each read of a file compares with what any session last saw of it; without the
    registry nothing is known."""
    if not config.registry_enabled:
        return actions.where("kind = 'read'").select("action_id", "file_path", F.lit("unknown").alias("status"))
    seen = last_sight(actions.where("kind = 'read'").select("action_id", "occurred_at", "file_path", "content_hash"), ["content_hash"])
    known = F.col("known_content_hash")
    status = F.when(known.isNull(), "unknown").when(known == F.col("content_hash"), "unchanged").otherwise("changed")
    return seen.select("action_id", "file_path", status.alias("status"))


def islands(ranges: DataFrame, keys: list[str], start: str = "s", end: str = "e") -> DataFrame:
    """Inclusive ranges merged where they overlap or touch; invalid ones (start under 1 or
    over the end) are dropped."""
    valid = ranges.where((F.col(start) >= 1) & (F.col(start) <= F.col(end)))
    by = W.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(by.rowsBetween(W.unboundedPreceding, -1))
    new = valid.withColumn("new", (before.isNull() | (F.col(start) > before + 1)).cast("int"))
    numbered = new.withColumn("island", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def keep_last(events: DataFrame, n: int = DEFAULT.replay_keep) -> DataFrame:
    """The newest n rows of each session."""
    w = W.partitionBy("session_id").orderBy(F.desc("action_id"))
    return events.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def sessions(actions: DataFrame) -> DataFrame:
    """Live sessions with their activity."""
    is_read = F.col("kind") == "read"
    return actions.groupBy("session_id").agg(
        F.min("occurred_at").alias("started_at"), F.max("occurred_at").alias("last_active"), F.count_if(is_read).alias("reads"),
        F.count_if(F.col("kind") == "reset").alias("compactions"), F.max(F.when(F.col("kind") == "reset", F.col("occurred_at"))).alias("last_compaction_at"),
    )
