"""Queries over the action log."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import DEFAULT
from ..functions import scalars as S
from ..operators import ledger as L
from ..operators import windows as V
from ..operators.scans import nearest_ranks, spread
from ..scratch import Scratch
from ..sources.tables import ACTIONS_SQL, actions, both_contents, files, plain_actions, raw_actions, table, versions

A = f"WITH {ACTIONS_SQL}"
SEG = f"""{A},
gaps AS (SELECT *, occurred_at - lag(occurred_at) OVER (PARTITION BY session_id ORDER BY occurred_at, action_id) AS gap FROM actions),
seg AS (SELECT *, CAST(coalesce(sum(CASE WHEN gap > 7200 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY occurred_at, action_id), 0) AS BIGINT) AS incarnation,
  CAST(sum(CASE WHEN kind = 'reset' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY occurred_at, action_id) AS BIGINT) AS epoch FROM gaps)"""


def _base(incarnation: str) -> str:
    w = f"OVER (PARTITION BY session_id, {incarnation}, epoch, file_path ORDER BY occurred_at, action_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    last = lambda c: f"last_value(CASE WHEN kind IN ('read', 'edit') THEN {c} END IGNORE NULLS) {w}"
    return f"""{SEG},
base AS (SELECT *, {last('content_hash')} AS prev_hash, {last('rev')} AS prev_rev, {last('n_bytes')} AS prev_bytes, {last('kind')} AS prev_kind FROM seg WHERE kind <> 'reset')"""


CLASSIFIED = f"""{_base('incarnation')},
classified AS (SELECT *, CASE WHEN kind <> 'read' THEN kind WHEN prev_hash IS NULL THEN 'first' WHEN prev_kind = 'edit' THEN 'passthrough'
  WHEN prev_hash = content_hash THEN 'unchanged' WHEN prev_bytes > 0 AND n_bytes * 2 < prev_bytes THEN 'fallback' ELSE 'delta' END AS outcome FROM base)"""
#: Sizes of diffs: lines are numbered, so no two of a text are equal, a diff is the lines that
#: differ at the same number, and changes that at most six lines part are one hunk.
DIFFS = """
ln AS (SELECT file_no, a, b, len(o) AS n, unnest(range(1, len(o) + 1)) AS k, unnest(o) AS ol, unnest(c) AS nl
  FROM (SELECT p.file_no, a, b, string_split(x.content, chr(10)) AS o, string_split(y.content, chr(10)) AS c
    FROM pairs p JOIN versions x ON x.file_no = p.file_no AND x.rev = a JOIN versions y ON y.file_no = p.file_no AND y.rev = b)),
ch AS (SELECT *, k - lag(k) OVER (PARTITION BY file_no, a, b ORDER BY k) AS gap FROM ln WHERE ol <> nl),
gr AS (SELECT *, sum(CASE WHEN gap <= 7 THEN 0 ELSE 1 END) OVER (PARTITION BY file_no, a, b ORDER BY k) AS g FROM ch),
hk AS (SELECT file_no, a, b, g, greatest(1, min(k) - 3) AS s, least(max(n), max(k) + 3) AS e, count(*) FILTER (NOT starts_with(nl, '++')) AS added, count(*) FILTER (NOT starts_with(ol, '--')) AS removed FROM gr GROUP BY ALL),
sz AS (SELECT ln.file_no, ln.a, ln.b, g, any_value(hk.s) AS first_line, any_value(hk.added) AS n_added, any_value(hk.removed) AS n_removed, max(ln.n) AS n_all,
  2 * any_value(strlen(CASE WHEN hk.s = hk.e THEN hk.s || '' ELSE hk.s || ',' || (hk.e - hk.s + 1) END)) + strlen('@@ - + @@' || chr(10))
  + sum(CASE WHEN ol = nl THEN strlen(nl) + 2 ELSE strlen(ol) + strlen(nl) + 4 + CASE WHEN k = ln.n THEN 2 * strlen('\\ No newline at end of file' || chr(10)) ELSE 0 END END) AS bytes
  FROM hk JOIN ln ON hk.file_no = ln.file_no AND hk.a = ln.a AND hk.b = ln.b AND k BETWEEN hk.s AND hk.e GROUP BY ln.file_no, ln.a, ln.b, g),
df AS (SELECT file_no, a, b, CAST(sum(bytes) + strlen('--- src/f' || file_no || '.txt (last read)' || chr(10) || '+++ src/f' || file_no || '.txt (current)' || chr(10)) AS BIGINT) AS diff_bytes,
  count(*) AS hunks, CAST(sum(n_added) AS BIGINT) AS added, CAST(sum(n_removed) AS BIGINT) AS removed, max(first_line) - min(first_line) AS span,
  CAST(sum(n_added) + sum(n_removed) AS FLOAT) / CAST(max(n_all) AS FLOAT) AS pct FROM sz GROUP BY file_no, a, b),
judged AS (SELECT *, hunks > 6 OR pct > CAST(0.4 AS FLOAT) OR (hunks > 3 AND span > 200) AS too_complex FROM df)"""
#: The lines that an edit touched are the runs of lines that differ.
CERTIFICATES = """
runs AS (SELECT *, k - row_number() OVER (PARTITION BY file_no, a, b ORDER BY k) AS run FROM ch),
spans AS (SELECT file_no, a, b, min(k) || '-' || max(k) AS lines FROM runs GROUP BY file_no, a, b, run),
touched AS (SELECT file_no, a, b, strlen(string_agg(lines, ', ')) AS listed FROM spans GROUP BY file_no, a, b)"""


def _account(window_seconds: int) -> str:
    return f"""{CLASSIFIED},
ed AS (SELECT session_id, incarnation, epoch, file_path, content_hash, occurred_at, action_id AS edit_id, prev_rev, rev FROM classified WHERE kind = 'edit' AND prev_hash <> content_hash),
cert AS (SELECT r.action_id, r.file_no, arg_max(ed.prev_rev, (ed.occurred_at, ed.edit_id)) AS a, arg_max(ed.rev, (ed.occurred_at, ed.edit_id)) AS b FROM classified r JOIN ed ON ed.session_id = r.session_id AND ed.file_path = r.file_path
  AND ed.incarnation = r.incarnation AND ed.epoch = r.epoch AND ed.content_hash = r.content_hash AND ed.occurred_at >= r.occurred_at - {window_seconds} AND (ed.occurred_at, ed.edit_id) < (r.occurred_at, r.action_id) WHERE r.outcome = 'passthrough' GROUP BY 1, 2),
pairs AS (SELECT file_no, prev_rev AS a, rev AS b FROM classified WHERE kind = 'read' AND outcome = 'delta' UNION SELECT file_no, a, b FROM cert), {DIFFS}, {CERTIFICATES},
sized AS (SELECT c.* EXCLUDE (outcome), outcome AS told, diff_bytes, too_complex, cert.action_id IS NOT NULL AS certified,
  strlen('[ledger: edit confirmed ' || file_path || ']' || chr(10)) + 12 + strlen(' -> ') + 12 + strlen(chr(10) || 'lines ') + listed + 1 AS cert_bytes,
  strlen('[ledger: ' || outcome || ' ' || file_path || ' ' || tokens_full || ' tokens]' || chr(10)) AS h FROM classified c LEFT JOIN cert ON cert.action_id = c.action_id
  LEFT JOIN judged j ON j.file_no = c.file_no AND j.a = coalesce(cert.a, c.prev_rev) AND j.b = coalesce(cert.b, c.rev) LEFT JOIN touched t ON t.file_no = j.file_no AND t.a = j.a AND t.b = j.b WHERE kind = 'read'),
why AS (SELECT *, CASE WHEN told IN ('first', 'delta', 'fallback') AND n_bytes > 102400 THEN 'large_file' WHEN told = 'fallback' THEN 'truncated' WHEN told = 'delta' AND too_complex THEN 'too_complex'
  WHEN told = 'delta' AND (h + diff_bytes + 3) // 4 >= tokens_full THEN 'diff_bigger' WHEN certified AND (cert_bytes + 3) // 4 >= tokens_full THEN 'overhead' WHEN told = 'unchanged' AND (h + 3) // 4 >= tokens_full THEN 'overhead' END AS reason FROM sized),
headed AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'fallback' WHEN certified THEN 'certificate' ELSE told END AS outcome FROM why),
account AS (SELECT action_id, session_id, file_path, occurred_at, outcome, reason, epoch, tokens_full AS charged_full,
  CAST(CASE outcome WHEN 'unchanged' THEN (h + 3) // 4 WHEN 'first' THEN (h + n_bytes + 3) // 4 WHEN 'delta' THEN (h + diff_bytes + 3) // 4 WHEN 'certificate' THEN (cert_bytes + 3) // 4 ELSE tokens_full END AS BIGINT) AS charged_sent FROM headed),
facts AS (SELECT *, CASE WHEN outcome = 'passthrough' THEN 0 ELSE charged_full END AS logged_full, CASE WHEN outcome = 'passthrough' THEN 0 ELSE charged_sent END AS logged_sent FROM account)"""


ACCOUNT = _account(DEFAULT.cert_window_seconds)


def told(spark, d, config=DEFAULT):
    """Each action's outcome; sessions of very many actions in blocks."""
    return L.classified(log(spark, d), config)


def log(spark, d):
    return spread(actions(spark, d), ["session_id"], raw_actions(spark, d))


def facts(spark, d, config=DEFAULT, kept=None):
    """What every read was charged. The log is read and classified once, then written; contents
    are fetched for the changes alone, and each change is diffed once. ``kept`` is what was written."""
    kept = kept or Scratch(spark, "ledger").keep(told(spark, d, config), "told")
    return L.accounting(kept, L.diff_sizes(both_contents(spark, d, L.changed_pairs(kept)), config), config)


def reads(spark, d):
    """The log's reads, for reports that don't need their outcomes."""
    return plain_actions(spark, d).where("kind = 'read'")


def times(spark, d):
    """The log for what only asks when actions were."""
    return spread(plain_actions(spark, d), ["session_id"], raw_actions(spark, d))


def _saved(df):
    return df.withColumn("saved", F.col("full_") - F.col("sent"))


def _roll(df, *keys):
    out = df.groupBy(*keys) if keys else df
    return out.agg(F.count("*").alias("reads"), F.coalesce(F.sum("charged_full"), F.lit(0)).alias("tokens_full"), F.coalesce(F.sum("charged_sent"), F.lit(0)).alias("tokens_sent"))


ROLL = "count(*) AS reads, CAST(coalesce(sum(charged_full), 0) AS BIGINT) AS tokens_full, CAST(coalesce(sum(charged_sent), 0) AS BIGINT) AS tokens_sent"
PCT = "CASE WHEN tokens_full > 0 THEN CAST(round(CAST(greatest(tokens_full - tokens_sent, 0) AS DOUBLE) / tokens_full * 100) AS INTEGER) ELSE 0 END AS pct"
Q: dict = {}


def q(name, sql=None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


@q("outcome_mix", f"""{SEG}, r AS (SELECT tokens_full, content_hash, lag(content_hash) OVER (PARTITION BY session_id, epoch, file_path ORDER BY occurred_at, action_id) AS p FROM seg WHERE kind = 'read')
SELECT CASE WHEN p IS NULL THEN 'first' WHEN p = content_hash THEN 'unchanged' ELSE 'delta' END AS outcome, count(*) AS n, CAST(sum(tokens_full) AS BIGINT) AS tokens_full FROM r GROUP BY 1""")
def _(spark, d):
    return L.outcome_mix(actions(spark, d))


@q("read_outcomes", f"{CLASSIFIED} SELECT action_id, session_id, file_path, outcome FROM classified")
def _(spark, d):
    return told(spark, d).select("action_id", "session_id", "file_path", "outcome")


@q("accounting", f"{ACCOUNT} SELECT action_id, outcome, reason, charged_full, charged_sent, CAST(logged_full AS BIGINT) AS logged_full, CAST(logged_sent AS BIGINT) AS logged_sent FROM facts")
def _(spark, d):
    return facts(spark, d).select("action_id", "outcome", "reason", "charged_full", "charged_sent", "logged_full", "logged_sent")


@q("certificate_accounting", f"{_account(7200)} SELECT action_id, outcome, charged_full, charged_sent FROM facts WHERE outcome IN ('certificate', 'passthrough')")
def _(spark, d):
    """Reads after edits, where an edit can be confirmed for two hours."""
    kept = facts(spark, d, replace(DEFAULT, cert_window_seconds=7200)).where(F.col("outcome").isin("certificate", "passthrough"))
    return kept.select("action_id", "outcome", "charged_full", "charged_sent")


@q("lifetime_headline", f"""{ACCOUNT}, x AS (SELECT {ROLL}, count(DISTINCT CASE WHEN charged_full > 0 THEN file_path END) AS files_tracked FROM facts),
e AS (SELECT count(*) AS total_edits, count(DISTINCT file_path) AS files_edited FROM actions WHERE kind = 'edit') SELECT reads, tokens_full, tokens_sent, tokens_full - tokens_sent AS saved, {PCT}, files_tracked, total_edits, files_edited FROM x, e""")
def _(spark, d):
    f = facts(spark, d).agg(
        F.count("*").alias("reads"), F.sum("charged_full").alias("tokens_full"), F.sum("charged_sent").alias("tokens_sent"),
        F.countDistinct(F.when(F.col("charged_full") > 0, F.col("file_path"))).alias("files_tracked"),
    )
    e = plain_actions(spark, d).where("kind = 'edit'").agg(F.count("*").alias("total_edits"), F.countDistinct("file_path").alias("files_edited"))
    both = f.withColumn("one", F.lit(1)).join(e.withColumn("one", F.lit(1)), "one").drop("one")
    return both.withColumns({"saved": F.col("tokens_full") - F.col("tokens_sent"), "pct": S.percent_saved(F.col("tokens_full"), F.col("tokens_sent"))})


@q("per_file", f"{ACCOUNT} SELECT file_path, {ROLL}, max(occurred_at) AS last_read_at FROM facts GROUP BY file_path")
def _(spark, d):
    f = facts(spark, d)
    return f.groupBy("file_path").agg(F.count("*").alias("reads"), F.sum("charged_full").alias("tokens_full"), F.sum("charged_sent").alias("tokens_sent"), F.max("occurred_at").alias("last_read_at"))


@q("daily", f"{ACCOUNT} SELECT strftime(make_timestamp(occurred_at * 1000000), '%Y-%m-%d') AS day, {ROLL} FROM facts GROUP BY 1")
def _(spark, d):
    return _roll(facts(spark, d).withColumn("day", S.day_of(F.col("occurred_at"))), "day")


NOW = 1706659200  # the reports' clock: the day after the log ends


@q("history_30d", f"{ACCOUNT}, x AS (SELECT strftime(make_timestamp(occurred_at * 1000000), '%Y-%m-%d') AS day, {ROLL} FROM facts WHERE occurred_at >= {NOW} - 30 * 86400 GROUP BY 1) SELECT *, {PCT} FROM x ORDER BY day DESC")
def _(spark, d):
    recent = facts(spark, d).where(F.col("occurred_at") >= NOW - DEFAULT.history_days * 86_400)
    out = _roll(recent.withColumn("day", S.day_of(F.col("occurred_at"))), "day")
    return out.withColumn("pct", S.percent_saved(F.col("tokens_full"), F.col("tokens_sent"))).orderBy(F.desc("day"))


def _top(df, *keys):
    out = df.groupBy(*keys, "file_path").agg(F.sum("charged_full").alias("tokens_full"), F.sum("charged_sent").alias("tokens_sent"))
    return out.where("tokens_full > tokens_sent").withColumn("saved", F.col("tokens_full") - F.col("tokens_sent"))


@q("top_files", f"{ACCOUNT}, x AS (SELECT file_path, CAST(sum(charged_full) AS BIGINT) AS tokens_full, CAST(sum(charged_sent) AS BIGINT) AS tokens_sent FROM facts GROUP BY 1) SELECT *, tokens_full - tokens_sent AS saved FROM x WHERE tokens_full > tokens_sent ORDER BY saved DESC, file_path LIMIT 10")
def _(spark, d):
    return _top(facts(spark, d), ).orderBy(F.desc("saved"), "file_path").limit(DEFAULT.top_n)


@q("top_files_session", f"{ACCOUNT}, x AS (SELECT session_id, file_path, CAST(sum(charged_full) AS BIGINT) AS tokens_full, CAST(sum(charged_sent) AS BIGINT) AS tokens_sent FROM facts GROUP BY 1, 2), y AS (SELECT *, tokens_full - tokens_sent AS saved FROM x WHERE tokens_full > tokens_sent) SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY saved DESC, file_path) <= 10")
def _(spark, d):
    w = W.partitionBy("session_id").orderBy(F.desc("saved"), "file_path")
    return _top(facts(spark, d), "session_id").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= DEFAULT.top_n).drop("rn")


@q("edit_counters", f"{A} SELECT file_path, count(*) AS edits, max(occurred_at) AS last_edit_at FROM actions WHERE kind = 'edit' GROUP BY 1")
def _(spark, d):
    return plain_actions(spark, d).where("kind = 'edit'").groupBy("file_path").agg(F.count("*").alias("edits"), F.max("occurred_at").alias("last_edit_at"))


@q("session_report", f"{ACCOUNT} SELECT session_id, count(DISTINCT file_path) AS files, {ROLL} FROM facts GROUP BY 1")
def _(spark, d):
    return facts(spark, d).groupBy("session_id").agg(F.countDistinct("file_path").alias("files"), F.count("*").alias("reads"), F.sum("charged_full").alias("tokens_full"), F.sum("charged_sent").alias("tokens_sent"))


SESS = "s AS (SELECT session_id, min(occurred_at) AS started_at, max(occurred_at) AS last_active FROM actions GROUP BY 1)"


@q("sessions_list", f"{ACCOUNT}, {SESS}, f AS (SELECT session_id, count(*) AS n, sum(charged_full - charged_sent) AS saved FROM facts GROUP BY 1) SELECT session_id, started_at, last_active, coalesce(n, 0) AS reads, CAST(coalesce(saved, 0) AS BIGINT) AS saved FROM s LEFT JOIN f USING (session_id) ORDER BY last_active DESC, session_id")
def _(spark, d):
    per = facts(spark, d).groupBy("session_id").agg(F.count("*").alias("n"), F.sum(F.col("charged_full") - F.col("charged_sent")).alias("s"))
    s = L.sessions(plain_actions(spark, d)).select("session_id", "started_at", "last_active")
    return s.join(per, "session_id", "left").select("session_id", "started_at", "last_active", F.coalesce("n", F.lit(0)).alias("reads"), F.coalesce("s", F.lit(0)).alias("saved")).orderBy(F.desc("last_active"), "session_id")


@q("default_session", f"{ACCOUNT}, {SESS} SELECT s.session_id, count(e.action_id) AS events FROM s LEFT JOIN facts e ON e.session_id = s.session_id GROUP BY s.session_id, s.last_active ORDER BY CASE WHEN count(e.action_id) > 0 THEN 0 ELSE 1 END, s.last_active DESC, s.session_id LIMIT 1")
def _(spark, d):
    s = L.sessions(plain_actions(spark, d)).select("session_id", "last_active")
    n = s.join(reads(spark, d).select("session_id", "action_id"), "session_id", "left").groupBy("session_id", "last_active").agg(F.count("action_id").alias("events"))
    return n.orderBy(F.when(F.col("events") > 0, 0).otherwise(1), F.desc("last_active"), "session_id").limit(1).select("session_id", "events")


@q("pick_session", f"{A}, {SESS}, r AS (SELECT session_id, count(*) AS reads FROM actions WHERE kind = 'read' GROUP BY 1) SELECT session_id, coalesce(reads, 0) AS reads, last_active FROM s LEFT JOIN r USING (session_id) ORDER BY CASE WHEN coalesce(reads, 0) >= 10 THEN 0 WHEN coalesce(reads, 0) > 0 THEN 1 ELSE 2 END, last_active DESC, session_id LIMIT 1")
def _(spark, d):
    s = L.sessions(plain_actions(spark, d)).select("session_id", "reads", "last_active")
    return s.orderBy(F.when(F.col("reads") >= 10, 0).when(F.col("reads") > 0, 1).otherwise(2), F.desc("last_active"), "session_id").limit(1)


@q("session_health", f"{A}, {SESS}, r AS (SELECT session_id, count(*) AS reads FROM actions WHERE kind = 'read' GROUP BY 1) SELECT count(*) AS sessions, count(*) FILTER (coalesce(reads, 0) = 0) AS without_reads, CAST(max(CASE WHEN last_active < {NOW} - 7200 THEN 1 ELSE 0 END) AS INTEGER) AS worst, count(*) FILTER (last_active < {NOW} - 7200) AS idle FROM s LEFT JOIN r USING (session_id)")
def _(spark, d):
    idle = F.col("last_active") < NOW - DEFAULT.ttl
    return L.sessions(plain_actions(spark, d)).agg(F.count("*").alias("sessions"), F.count_if(F.col("reads") == 0).alias("without_reads"), F.max(idle.cast("int")).alias("worst"), F.count_if(idle).alias("idle"))


@q("ttl_incarnations", f"{SEG} SELECT session_id, max(incarnation) + 1 AS incarnations, count(*) AS actions FROM seg GROUP BY 1")
def _(spark, d):
    s = L.segments(times(spark, d))
    return s.groupBy("session_id").agg((F.max("incarnation") + 1).alias("incarnations"), F.count("*").alias("actions"))


@q("expired_notice", f"{SEG} SELECT action_id, session_id, gap, gap <= 86400 + 7200 AS announced FROM seg WHERE gap > 7200")
def _(spark, d):
    s = L.segments(times(spark, d)).where(F.col("gap") > DEFAULT.ttl)
    return s.select("action_id", "session_id", "gap", (F.col("gap") <= DEFAULT.tombstone_seconds + DEFAULT.ttl).alias("announced"))


@q("ttl_warning", f"{SEG} SELECT action_id, 7200 - gap AS left_ FROM seg WHERE gap BETWEEN 6480 AND 7200")
def _(spark, d):
    s = L.segments(times(spark, d)).where(F.col("gap").between(DEFAULT.ttl * 9 // 10, DEFAULT.ttl))
    return s.select("action_id", (F.lit(DEFAULT.ttl) - F.col("gap")).alias("left_"))


@q("compaction_stats", f"{ACCOUNT}, c AS (SELECT count(*) AS compactions, max(occurred_at) AS last_at FROM actions WHERE kind = 'reset') SELECT compactions, last_at, CAST((SELECT sum(charged_full) FROM facts WHERE epoch > 0) AS BIGINT) AS tokens_after FROM c WHERE compactions > 0")
def _(spark, d):
    c = plain_actions(spark, d).where("kind = 'reset'").agg(F.count("*").alias("compactions"), F.max("occurred_at").alias("last_at"), F.lit(1).alias("one"))
    t = facts(spark, d).agg(F.sum(F.when(F.col("epoch") > 0, F.col("charged_full"))).alias("tokens_after"), F.lit(1).alias("one"))
    return c.where("compactions > 0").join(t, "one").drop("one")


@q("compaction_by_session", f"{A} SELECT session_id, count(*) AS compactions, max(occurred_at) AS last_at FROM actions WHERE kind = 'reset' GROUP BY 1")
def _(spark, d):
    return plain_actions(spark, d).where("kind = 'reset'").groupBy("session_id").agg(F.count("*").alias("compactions"), F.max("occurred_at").alias("last_at"))


@q("oob_refreshes", f"{_base('incarnation')} SELECT session_id, count(*) FILTER (prev_hash <> content_hash AND prev_kind = 'read') AS refreshes, count(*) AS reads, CAST(round(100.0::DOUBLE * count(*) FILTER (prev_hash <> content_hash AND prev_kind = 'read') / count(*)) AS INTEGER) AS pct FROM base WHERE kind = 'read' GROUP BY 1")
def _(spark, d):
    outside = (F.col("prev_hash") != F.col("content_hash")) & (F.col("prev_kind") == "read")
    out = L.baselines(L.segments(log(spark, d))).where("kind = 'read'").groupBy("session_id").agg(F.count_if(outside).alias("refreshes"), F.count("*").alias("reads"))
    return out.withColumn("pct", F.round(F.lit(100.0) * F.col("refreshes") / F.col("reads")).cast("int"))


REG = "reg AS (SELECT file_path, count(*) AS reads_count, max(occurred_at) AS last_seen_at, arg_max(content_hash, occurred_at * 1000000000 + action_id) AS content_hash, arg_max(n_bytes, occurred_at * 1000000000 + action_id) AS n_bytes FROM actions WHERE kind = 'read' GROUP BY 1)"


def registry(spark, d):
    at = F.struct("occurred_at", "action_id")
    r = actions(spark, d).where("kind = 'read'").groupBy("file_path")
    return r.agg(F.count("*").alias("reads_count"), F.max("occurred_at").alias("last_seen_at"), F.max_by("content_hash", at).alias("content_hash"), F.max_by("n_bytes", at).alias("n_bytes"))


@q("registry_stats", f"{A}, {REG} SELECT count(*) AS files, CAST(sum(CASE WHEN n_bytes <= 32768 THEN 1 ELSE 0 END) AS BIGINT) AS inline_rows, CAST(sum(CASE WHEN n_bytes <= 32768 THEN n_bytes ELSE 0 END) AS BIGINT) AS inline_bytes, CAST(sum(CASE WHEN n_bytes > 32768 THEN 1 ELSE 0 END) AS BIGINT) AS file_rows, CAST(sum(reads_count) AS BIGINT) AS reads, arg_min(file_path, (last_seen_at, file_path)) AS oldest, arg_min(file_path, (-reads_count, file_path)) AS most_read FROM reg")
def _(spark, d):
    small = F.col("n_bytes") <= DEFAULT.inline_max_bytes
    return registry(spark, d).agg(
        F.count("*").alias("files"), F.sum(small.cast("long")).alias("inline_rows"), F.sum(F.when(small, F.col("n_bytes")).otherwise(0)).alias("inline_bytes"),
        F.sum((~small).cast("long")).alias("file_rows"), F.sum("reads_count").alias("reads"),
        F.min_by("file_path", F.struct("last_seen_at", "file_path")).alias("oldest"), F.min_by("file_path", F.struct(-F.col("reads_count"), "file_path")).alias("most_read"),
    )


@q("registry_status", f"{A}, r AS (SELECT action_id, file_path, content_hash, lag(content_hash) OVER (PARTITION BY file_path ORDER BY occurred_at, action_id) AS known FROM actions WHERE kind = 'read') SELECT action_id, file_path, CASE WHEN known IS NULL THEN 'unknown' WHEN known = content_hash THEN 'unchanged' ELSE 'changed' END AS status FROM r")
def _(spark, d):
    return L.registry_status(actions(spark, d))


@q("registry_gc", f"{A}, {REG}, x AS (SELECT *, last_seen_at <= (SELECT max(last_seen_at) FROM reg) - 3600 AS removed FROM reg) SELECT removed, count(*) AS files, CAST(sum(reads_count) AS BIGINT) AS reads FROM x GROUP BY 1")
def _(spark, d):
    r = registry(spark, d)
    newest = r.agg(F.max("last_seen_at").alias("newest"))
    return r.join(F.broadcast(newest)).groupBy((F.col("last_seen_at") <= F.col("newest") - 3600).alias("removed")).agg(F.count("*").alias("files"), F.sum("reads_count").alias("reads"))


@q("ghost_share", "WITH f AS (SELECT doc_id, CAST((strlen(text) + 3) // 4 AS BIGINT) AS t FROM documents), g AS (SELECT CAST(sum(t) AS BIGINT) AS total, CAST(sum(CASE WHEN doc_id NOT IN (SELECT doc_id FROM labels) THEN t ELSE 0 END) AS BIGINT) AS ghost FROM f) SELECT total, ghost, CAST(round(CAST(100 * ghost AS DOUBLE) / total) AS INTEGER) AS pct, round(CAST(100 * ghost AS DOUBLE) / total) >= 50 AS hint FROM g")
def _(spark, d):
    f = files(spark, d).select("doc_id", S.token_estimate(F.col("content")).alias("t"))
    live = table(spark, d, "labels").select("doc_id").distinct().withColumn("live", F.lit(True))
    g = f.join(live, "doc_id", "left").agg(F.sum("t").alias("total"), F.sum(F.when(F.col("live").isNull(), F.col("t")).otherwise(0)).alias("ghost"))
    share = F.round((100 * F.col("ghost")).cast("double") / F.col("total"))
    return g.withColumns({"pct": share.cast("int"), "hint": share >= DEFAULT.ghost_threshold})


@q("prune_report", "SELECT count(*) AS removed, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return files(spark, d).join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("removed"), F.sum(F.octet_length("content").cast("long")).alias("bytes"))


@q("resync_check", f"{ACCOUNT}, a AS (SELECT 'headline' AS level, {ROLL} FROM facts), b AS (SELECT file_path, {ROLL} FROM facts GROUP BY 1), c AS (SELECT occurred_at // 86400 AS day, {ROLL} FROM facts GROUP BY 1) SELECT * FROM a UNION ALL SELECT 'per_file', CAST(sum(reads) AS BIGINT), CAST(sum(tokens_full) AS BIGINT), CAST(sum(tokens_sent) AS BIGINT) FROM b UNION ALL SELECT 'daily', CAST(sum(reads) AS BIGINT), CAST(sum(tokens_full) AS BIGINT), CAST(sum(tokens_sent) AS BIGINT) FROM c")
def _(spark, d):
    f = facts(spark, d).withColumn("day", F.floor(F.col("occurred_at") / 86_400))
    total = lambda df: df.agg(F.sum("reads").alias("reads"), F.sum("tokens_full").alias("tokens_full"), F.sum("tokens_sent").alias("tokens_sent"))
    parts = {"headline": _roll(f), "per_file": total(_roll(f, "file_path")), "daily": total(_roll(f, "day"))}
    out = None
    for level, df in parts.items():
        df = df.select(F.lit(level).alias("level"), "reads", "tokens_full", "tokens_sent")
        out = df if out is None else out.unionByName(df)
    return out


EV = f"{ACCOUNT}, ev AS (SELECT * FROM facts)"


@q("replay_last_n", f"{EV} SELECT row_number() OVER (ORDER BY action_id) AS n, action_id, session_id, outcome FROM (SELECT * FROM ev ORDER BY action_id DESC LIMIT 50) ORDER BY n")
def _(spark, d):
    last = facts(spark, d).orderBy(F.desc("action_id")).limit(DEFAULT.replay_limit)
    return last.select(F.row_number().over(W.orderBy("action_id")).cast("long").alias("n"), "action_id", "session_id", "outcome")  # of replay_limit rows


@q("replay_filtered", f"{EV} SELECT action_id, session_id, file_path, outcome FROM ev WHERE occurred_at >= {NOW} - 15 * 86400 AND file_path ILIKE '%F1%'")
def _(spark, d):
    return facts(spark, d).where((F.col("occurred_at") >= NOW - 15 * 86_400) & F.ilike("file_path", F.lit("%F1%"))).select("action_id", "session_id", "file_path", "outcome")


@q("replay_summary", f"{EV}, x AS (SELECT outcome, reason, count(*) AS n, CAST(sum(logged_full) AS BIGINT) AS tokens_full, CAST(sum(logged_sent) AS BIGINT) AS tokens_sent FROM ev GROUP BY 1, 2) SELECT *, {PCT} FROM x")
def _(spark, d):
    x = facts(spark, d).groupBy("outcome", "reason").agg(F.count("*").alias("n"), F.sum("logged_full").alias("tokens_full"), F.sum("logged_sent").alias("tokens_sent"))
    return x.withColumn("pct", S.percent_saved(F.col("tokens_full"), F.col("tokens_sent")))


@q("keep_last_n", f"{EV} SELECT action_id, session_id FROM ev QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY action_id DESC) <= 20")
def _(spark, d):
    return L.keep_last(reads(spark, d), 20).select("action_id", "session_id")


@q("ranges_merge", f"""{A}, r AS (SELECT session_id, file_path, win_start AS s, win_end AS e FROM actions WHERE kind = 'partial' AND win_start >= 1 AND win_start <= win_end),
b AS (SELECT *, max(e) OVER (PARTITION BY session_id, file_path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM r),
i AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, file_path ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM b)
SELECT session_id, file_path, min(s) AS s, max(e) AS e FROM i GROUP BY session_id, file_path, island""")
def _(spark, d):
    r = actions(spark, d).where("kind = 'partial'").select("session_id", "file_path", F.col("win_start").alias("s"), F.col("win_end").alias("e"))
    return L.islands(r, ["session_id", "file_path"])


@q("edit_events", f"{_base('incarnation')} SELECT session_id, file_path, action_id AS edit_id, prev_hash AS before_hash, content_hash AS after_hash, occurred_at AS edited_at FROM base WHERE kind = 'edit' AND prev_hash <> content_hash")
def _(spark, d):
    return L.edit_events(actions(spark, d))


@q("edit_certificates", f"""{_base('0')}, ed AS (SELECT * FROM base WHERE kind = 'edit' AND prev_hash <> content_hash), rd AS (SELECT * FROM base WHERE kind = 'read' AND prev_kind = 'edit')
SELECT rd.action_id, arg_max(ed.action_id, (ed.occurred_at, ed.action_id)) AS edit_id FROM rd LEFT JOIN ed ON ed.session_id = rd.session_id AND ed.file_path = rd.file_path AND ed.content_hash = rd.content_hash AND ed.occurred_at BETWEEN rd.occurred_at - 86400 AND rd.occurred_at GROUP BY 1""")
def _(spark, d):
    return L.certificates(actions(spark, d), 86_400)


IDLE = f"idle AS (SELECT session_id FROM actions GROUP BY 1 HAVING max(occurred_at) < {NOW} - 4000)"
#: What is kept is all that was active within three days.
STALE = f"idle AS (SELECT session_id FROM actions GROUP BY 1 HAVING max(occurred_at) < {NOW} - 3 * 86400)"


def _idle(spark, d, seconds=4000):
    return L.sessions(plain_actions(spark, d)).where(F.col("last_active") < NOW - seconds).select("session_id")


@q("purge_semi", f"{A}, {IDLE} SELECT session_id, count(*) AS purged FROM actions WHERE session_id IN (SELECT session_id FROM idle) GROUP BY 1")
def _(spark, d):
    return plain_actions(spark, d).join(_idle(spark, d), "session_id", "left_semi").groupBy("session_id").agg(F.count("*").alias("purged"))


@q("orphan_anti", f"{A}, {STALE} SELECT session_id, count(*) AS kept FROM actions WHERE session_id NOT IN (SELECT session_id FROM idle) GROUP BY 1")
def _(spark, d):
    return plain_actions(spark, d).join(_idle(spark, d, 3 * 86_400), "session_id", "left_anti").groupBy("session_id").agg(F.count("*").alias("kept"))


@q("row_counts", f"{ACCOUNT} SELECT 'actions' AS name, count(*) AS n FROM actions UNION ALL SELECT 'reads', count(*) FROM facts UNION ALL SELECT 'files', count(DISTINCT file_path) FROM actions UNION ALL SELECT 'sessions', count(DISTINCT session_id) FROM actions")
def _(spark, d):
    a = plain_actions(spark, d)
    one = lambda name, df: df.select(F.lit(name).alias("name"), "n")
    return (
        one("actions", a.agg(F.count("*").alias("n"))).unionByName(one("reads", reads(spark, d).agg(F.count("*").alias("n"))))
        .unionByName(one("files", a.agg(F.countDistinct("file_path").alias("n")))).unionByName(one("sessions", a.agg(F.countDistinct("session_id").alias("n"))))
    )


@q("reset_marker", f"{A}, m AS (SELECT session_id, max(occurred_at) FILTER (kind = 'reset') AS reset_at, min(occurred_at) AS installed_at FROM actions GROUP BY 1) SELECT session_id, coalesce(reset_at, installed_at) AS since, (SELECT count(*) FROM actions a WHERE a.session_id = m.session_id AND a.kind = 'read' AND a.occurred_at >= coalesce(reset_at, installed_at)) AS reads FROM m")
def _(spark, d):
    a = plain_actions(spark, d)
    m = a.groupBy("session_id").agg(F.coalesce(F.max(F.when(F.col("kind") == "reset", F.col("occurred_at"))), F.min("occurred_at")).alias("since"))
    own = (F.col("kind") == "read") & (F.col("occurred_at") >= F.col("since"))
    return a.join(m, "session_id").groupBy("session_id", "since").agg(F.count_if(own).alias("reads"))


@q("baselines_for_file", f"{A} SELECT session_id, arg_max(content_hash, (occurred_at, action_id)) AS content_hash FROM actions WHERE kind = 'read' AND file_path = 'src/f2.txt' GROUP BY 1")
def _(spark, d):
    r = actions(spark, d).where("kind = 'read' and file_path = 'src/f2.txt'")
    return r.groupBy("session_id").agg(F.max_by("content_hash", F.struct("occurred_at", "action_id")).alias("content_hash"))


@q("refresh_barrier", f"""{A}, m AS (SELECT file_path, min(occurred_at) + 86400 AS at_ FROM actions GROUP BY 1),
r AS (SELECT a.*, a.occurred_at >= m.at_ AS late FROM actions a JOIN m USING (file_path) WHERE kind = 'read'),
p AS (SELECT *, lag(content_hash) OVER (PARTITION BY session_id, file_path, late ORDER BY occurred_at, action_id) AS p FROM r)
SELECT late, count(*) AS reads, count(*) FILTER (p IS NULL) AS firsts FROM p GROUP BY 1""")
def _(spark, d):
    a = actions(spark, d)
    m = a.groupBy("file_path").agg((F.min("occurred_at") + 86_400).alias("at_"))
    r = a.where("kind = 'read'").join(m, "file_path").withColumn("late", F.col("occurred_at") >= F.col("at_"))
    p = F.lag("content_hash").over(W.partitionBy("session_id", "file_path", "late").orderBy(*L.ORDER))
    return r.withColumn("p", p).groupBy("late").agg(F.count("*").alias("reads"), F.count_if(F.col("p").isNull()).alias("firsts"))


@q("quantiles", f"{A}, r AS (SELECT tokens_full AS t, row_number() OVER (ORDER BY tokens_full, action_id) - 1 AS i, count(*) OVER () AS n FROM actions WHERE kind = 'read') SELECT max(t) FILTER (i = CAST(round(0.5 * (n - 1)) AS BIGINT)) AS p50, max(t) FILTER (i = CAST(round(0.95 * (n - 1)) AS BIGINT)) AS p95, max(t) FILTER (i = CAST(round(0.99 * (n - 1)) AS BIGINT)) AS p99 FROM r")
def _(spark, d):
    values = actions(spark, d).where("kind = 'read'").select("tokens_full")
    found = nearest_ranks(values, [0.5, 0.95, 0.99], Scratch(spark, "quantiles"))
    return spark.createDataFrame([tuple(found)], "p50 long, p95 long, p99 long")


PRICES = (("small", 1.0), ("medium", 3.0), ("large", 15.0))


@q("cost_projection", f"{ACCOUNT}, t AS (SELECT CAST(sum(charged_full - charged_sent) AS DOUBLE) AS saved FROM facts), p(model, price) AS (VALUES ('small', 1.0::DOUBLE), ('medium', 3.0::DOUBLE), ('large', 15.0::DOUBLE)) SELECT model, round(saved * 110 / 1e6::DOUBLE * price, 4) AS dollars FROM t, p")
def _(spark, d):
    t = facts(spark, d).agg(F.sum(F.col("charged_full") - F.col("charged_sent")).cast("double").alias("saved"))
    rows = t.select("saved", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(p).alias("price")) for m, p in PRICES])).alias("x"))
    return rows.select("x.model", F.round(F.col("saved") * 110 / F.lit(1e6) * F.col("x.price"), 4).alias("dollars"))


@q("savings_ratio", f"{ACCOUNT}, x AS (SELECT session_id, sum(charged_full) AS f, sum(charged_sent) AS s FROM facts GROUP BY 1) SELECT round(1 - CAST(sum(s) AS DOUBLE) / sum(f), 6) AS of_totals, round(avg(1 - CAST(s AS DOUBLE) / f), 6) AS of_sessions FROM x")
def _(spark, d):
    x = facts(spark, d).groupBy("session_id").agg(F.sum("charged_full").alias("f"), F.sum("charged_sent").alias("s"))
    return x.agg(F.round(1 - F.sum("s").cast("double") / F.sum("f"), 6).alias("of_totals"), F.round(F.avg(1 - F.col("s").cast("double") / F.col("f")), 6).alias("of_sessions"))


@q("money_saved", f"{ACCOUNT}, x AS (SELECT session_id, CAST(sum(charged_full - charged_sent) AS BIGINT) AS saved FROM facts GROUP BY 1) SELECT session_id, saved, round(CAST(greatest(saved, 0) AS DOUBLE) / 1e6::DOUBLE * 3.0::DOUBLE, 9) AS dollars, round(CAST(greatest(saved, 0) AS DOUBLE) / 1e3::DOUBLE * 0.4::DOUBLE, 9) AS co2_g FROM x")
def _(spark, d):
    x = facts(spark, d).groupBy("session_id").agg(F.sum(F.col("charged_full") - F.col("charged_sent")).alias("saved"))
    return x.withColumns({"dollars": F.round(S.dollars_saved(F.col("saved")), 9), "co2_g": F.round(S.co2_saved(F.col("saved")), 9)})


@q("rendered_headers", f"""{CLASSIFIED}, x AS (SELECT *, occurred_at - lag(occurred_at) OVER (PARTITION BY session_id, file_path ORDER BY occurred_at, action_id) AS age FROM classified WHERE kind = 'read')
SELECT action_id, '[ledger: unchanged ' || file_path || ', ' || tokens_full || ' tokens, last read ' || CASE WHEN age < 60 THEN age || 's' WHEN age < 3600 THEN age // 60 || 'm' WHEN age < 86400 THEN age // 3600 || 'h' ELSE age // 86400 || 'd' END || ' ago]' || chr(10) AS header FROM x WHERE age IS NOT NULL""")
def _(spark, d):
    from ..functions import render

    reads = told(spark, d).where("kind = 'read'")
    age = F.col("occurred_at") - F.lag("occurred_at").over(W.partitionBy("session_id", "file_path").orderBy(*L.ORDER))
    return reads.withColumn("age", age).where("age is not null").select("action_id", render.unchanged(F.col("file_path"), F.col("tokens_full"), F.col("age")).alias("header"))


@q("rendered_replies", f"""{ACCOUNT}, r AS (SELECT action_id, content_hash, lag(content_hash) OVER (PARTITION BY file_path ORDER BY occurred_at, action_id) AS known FROM actions WHERE kind = 'read'),
t AS (SELECT f.*, CASE WHEN known IS NULL THEN NULL WHEN known = content_hash THEN 'unchanged' ELSE 'changed' END AS status, row_number() OVER w AS n, CAST(sum(charged_full - charged_sent) OVER w AS BIGINT) AS saved
  FROM facts f JOIN r USING (action_id) WINDOW w AS (PARTITION BY session_id ORDER BY occurred_at, action_id))
SELECT action_id, CASE WHEN outcome = 'fallback' THEN '[ledger: full ' || file_path || ', ' || CASE reason WHEN 'large_file' THEN 'large file' WHEN 'truncated' THEN 'file shrank by more than half' WHEN 'too_complex' THEN 'diff is too complex'
    WHEN 'diff_bigger' THEN 'diff is larger than the file' WHEN 'overhead' THEN 'reply is larger than the file' END || ']' || chr(10)
  WHEN outcome IN ('first', 'unchanged', 'delta') THEN '[ledger: ' || outcome || ' ' || file_path || ' ' || charged_full || ' tokens]' || chr(10) ELSE '' END
  || CASE WHEN outcome = 'first' AND status IS NOT NULL THEN '[ledger: file ' || status || ' since another session]' || chr(10) ELSE '' END
  || 'session ' || substr(session_id, 1, 8) || ', ' || n || ' reads, ' || saved || ' tokens saved' AS reply FROM t""")
def _(spark, d):
    kept = Scratch(spark, "ledger").keep(told(spark, d), "told")  # has all reads, for both
    return L.replies(facts(spark, d, kept=kept), L.registry_status(kept))


@q("window_headers", f"{A} SELECT action_id, strlen('[ledger: unchanged ' || file_path || ', lines ' || win_start || '-' || win_end || ']' || chr(10)) AS bytes, (strlen('[ledger: unchanged ' || file_path || ', lines ' || win_start || '-' || win_end || ']' || chr(10)) + 3) // 4 AS tokens FROM actions WHERE kind = 'partial'")
def _(spark, d):
    from ..functions import render

    p = actions(spark, d).where("kind = 'partial'")
    h = render.window_unchanged(F.col("file_path"), F.col("win_start"), F.col("win_end"))
    return p.select("action_id", F.octet_length(h).cast("long").alias("bytes"), S.token_estimate(h).alias("tokens"))


@q("running_counts", f"{A} SELECT action_id, count(*) OVER (PARTITION BY session_id, file_path ORDER BY occurred_at, action_id) AS reads_count FROM actions WHERE kind = 'read'")
def _(spark, d):
    w = W.partitionBy("session_id", "file_path").orderBy(*L.ORDER)
    return actions(spark, d).where("kind = 'read'").select("action_id", F.count("*").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("reads_count"))


@q("one_shot_marker", f"{_base('0')} SELECT action_id, file_path FROM base WHERE kind = 'read' AND prev_kind = 'edit'")
def _(spark, d):
    """Full reads that use up the mark an edit left; partial reads leave it."""
    b = L.baselines(L.segments(log(spark, d), ttl=False))
    return b.where("kind = 'read' and prev_kind = 'edit'").select("action_id", "file_path")


@q("native_delivery", f"""{_base('incarnation')} SELECT CASE WHEN prev_hash IS NULL THEN 'first' WHEN prev_kind = 'edit' THEN 'passthrough' WHEN prev_hash = content_hash THEN 'unchanged' ELSE 'external_change' END AS outcome, count(*) AS n, CAST(sum(tokens_full) AS BIGINT) AS tokens FROM base WHERE kind = 'read' GROUP BY 1""")
def _(spark, d):
    """Delivery by the agent itself: a change from outside is sent in full, not as a delta."""
    c = told(spark, d).where("kind = 'read'")
    outcome = F.when(F.col("outcome").isin("delta", "fallback"), "external_change").otherwise(F.col("outcome"))
    return c.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"), F.sum("tokens_full").alias("tokens"))


@q("partial_windows", f"""{_base('incarnation')} SELECT action_id, CASE WHEN prev_hash IS NULL THEN 'silent' WHEN prev_hash <> content_hash THEN 'external' ELSE 'known' END AS state FROM base WHERE kind = 'partial'""")
def _(spark, d):
    state = F.when(F.col("prev_hash").isNull(), "silent").when(F.col("prev_hash") != F.col("content_hash"), "external").otherwise("known")
    return L.baselines(L.segments(log(spark, d))).where("kind = 'partial'").select("action_id", state.alias("state"))


#: The machine with windows. ``know`` has each action's baseline, ``grp`` the sets of seen
#: lines; a line is open if no earlier window or full read of the set has it.
WINDOWS = f"""{SEG},
work AS (SELECT * FROM seg WHERE kind IN ('read', 'edit', 'partial')),
know AS (SELECT *, lag(content_hash) OVER f AS k_hash, lag(n_lines) OVER f AS k_lines, lag(n_bytes) OVER f AS k_bytes,
  last_value(CASE WHEN kind <> 'partial' THEN kind END IGNORE NULLS) OVER (PARTITION BY session_id, incarnation, epoch, file_path ORDER BY occurred_at, action_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_kind
  FROM work WINDOW f AS (PARTITION BY session_id, incarnation, epoch, file_path ORDER BY occurred_at, action_id)),
begun AS (SELECT *, kind = 'read' OR (kind = 'partial' AND (k_hash IS NULL OR k_hash <> content_hash)) AS begins FROM know),
grp AS (SELECT *, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, incarnation, epoch, file_path ORDER BY occurred_at, action_id) AS g,
  greatest(win_start, 1) AS a, least(win_end, greatest(n_lines, coalesce(k_lines, 0), win_start, 1)) AS b FROM begun),
shown AS (SELECT session_id, incarnation, epoch, file_path, g, occurred_at, action_id, CASE WHEN kind = 'read' THEN 1 ELSE a END AS s, CASE WHEN kind = 'read' THEN n_lines ELSE b END AS e FROM grp WHERE kind <> 'edit'),
asked AS (SELECT session_id, incarnation, epoch, file_path, occurred_at, action_id, CASE WHEN kind = 'read' THEN g - 1 ELSE g END AS g,
  unnest(CASE WHEN kind = 'read' THEN range(1, coalesce(k_lines, 0) + 1) ELSE range(a, b + 1) END) AS line FROM grp WHERE kind = 'read' OR (kind = 'partial' AND NOT begins)),
open_ AS (SELECT DISTINCT action_id FROM asked WHERE NOT EXISTS (SELECT 1 FROM shown WHERE shown.session_id = asked.session_id AND shown.incarnation = asked.incarnation AND shown.epoch = asked.epoch
  AND shown.file_path = asked.file_path AND shown.g = asked.g AND (shown.occurred_at, shown.action_id) < (asked.occurred_at, asked.action_id) AND line BETWEEN s AND e)),
windowed AS (SELECT grp.*, open_.action_id IS NOT NULL AS open FROM grp LEFT JOIN open_ ON open_.action_id = grp.action_id),
machine AS (SELECT *, CASE WHEN kind = 'edit' THEN 'edit'
  WHEN kind = 'read' THEN CASE WHEN k_hash IS NULL THEN 'first' WHEN last_kind = 'edit' THEN 'passthrough' WHEN open THEN 'first' WHEN k_hash = content_hash THEN 'unchanged'
    WHEN k_bytes > 0 AND n_bytes * 2 < k_bytes THEN 'fallback' ELSE 'delta' END
  WHEN k_hash IS NULL THEN 'partial-silent' WHEN k_hash <> content_hash THEN 'partial-external' WHEN open OR a > b THEN 'partial-uncovered' ELSE 'partial-unchanged' END AS outcome FROM windowed)"""


@q("machine_outcomes", f"{WINDOWS} SELECT action_id, session_id, file_path, outcome FROM machine UNION ALL SELECT action_id, session_id, file_path, 'reset' FROM actions WHERE kind = 'reset'")
def _(spark, d):
    """Every action's outcome, windows of lines included."""
    return V.machine(log(spark, d))


@q("covered_reads", f"{WINDOWS} SELECT action_id, outcome FROM machine WHERE kind = 'read'")
def _(spark, d):
    """Full reads, where one of a file that was seen in part is a first one."""
    return V.outcomes(log(spark, d)).where("kind = 'read'").select("action_id", "outcome")


@q("window_accounting", f"""{WINDOWS}, cut AS (SELECT m.*, string_split(v.content, chr(10)) AS ls, v.content FROM machine m JOIN versions v USING (file_no, rev) WHERE kind = 'partial'),
told AS (SELECT action_id, outcome, a AS first_line, b AS last_line,
  CAST((CASE WHEN a > n_lines THEN 0 ELSE strlen(array_to_string(ls[a:least(win_end, n_lines)], chr(10))) + CASE WHEN ends_with(content, chr(10)) OR win_end < n_lines THEN 1 ELSE 0 END END + 3) // 4 AS BIGINT) AS w,
  CAST((strlen('[ledger: unchanged ' || file_path || ', lines ' || a || '-' || b || ']' || chr(10)) + 3) // 4 AS BIGINT) AS r FROM cut)
SELECT action_id, CASE WHEN outcome = 'partial-unchanged' AND r >= w THEN 'partial-gated' ELSE outcome END AS outcome, first_line, last_line, w AS charged_full,
  CASE WHEN outcome = 'partial-unchanged' AND r < w THEN r ELSE w END AS charged_sent FROM told""")
def _(spark, d):
    """What reads of line windows are charged."""
    return V.charges(V.outcomes(log(spark, d)), versions(spark, d))


@q("session_start", f"{SEG} SELECT session_id, incarnation, epoch, min(occurred_at) AS started_at, max(occurred_at) AS last_active, count(*) AS actions FROM seg GROUP BY 1, 2, 3")
def _(spark, d):
    s = L.segments(times(spark, d))
    return s.groupBy("session_id", "incarnation", "epoch").agg(F.min("occurred_at").alias("started_at"), F.max("occurred_at").alias("last_active"), F.count("*").alias("actions"))
