"""Queries over file contents, storage, labels and payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import scalars as S
from ..scratch import Scratch
from ..sources import requests as R
from ..sources.store import ContentStore
from ..sources.tables import ACTIONS_SQL, FILES_SQL, actions, files, table
from .ledger import CLASSIFIED

Q: dict = {}
FL = f"WITH {FILES_SQL}"
TOKENS = "CAST((strlen(content) + 3) // 4 AS BIGINT)"
LINES = "CAST(length(content) - length(replace(content, chr(10), '')) + CASE WHEN content <> '' AND NOT ends_with(content, chr(10)) THEN 1 ELSE 0 END AS BIGINT)"


def q(name, sql=None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


C = F.col


@q("token_estimate", f"{FL} SELECT doc_id, {TOKENS} AS tokens FROM files")
def _(spark, d):
    return files(spark, d).select("doc_id", S.token_estimate(C("content")).alias("tokens"))


@q("content_hash", f"{FL} SELECT doc_id, sha256(content) AS content_hash, substr(sha256('k:' || content), 1, 16) AS short FROM files")
def _(spark, d):
    return files(spark, d).select("doc_id", S.content_hash(C("content")).alias("content_hash"), S.short_hash(F.lit("k:"), C("content")).alias("short"))


@q("line_count", f"{FL} SELECT doc_id, {LINES} AS n_lines FROM files")
def _(spark, d):
    return files(spark, d).select("doc_id", S.line_count(C("content")).alias("n_lines"))


@q("file_kind", f"{FL} SELECT doc_id, CASE WHEN strlen(content) > 102400 THEN 'too_large' WHEN contains(substr(content, 1, 8192), chr(0)) THEN 'binary' ELSE 'text' END AS kind FROM files")
def _(spark, d):
    return files(spark, d).select("doc_id", S.file_kind(C("content").cast("binary")).alias("kind"))


@q("oversize_skip", f"{FL} SELECT doc_id, CASE WHEN strlen(content) > 8000 THEN 'oversized:' || strlen(content) ELSE sha256(content) END AS content_hash FROM files")
def _(spark, d):
    big = F.octet_length("content") > 8000
    return files(spark, d).select("doc_id", F.when(big, F.concat(F.lit("oversized:"), F.octet_length("content").cast("string"))).otherwise(S.content_hash(C("content"))).alias("content_hash"))


@q("truncation_gate", "WITH x AS (SELECT doc_id, strlen(text) AS b, lag(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id) AS a FROM documents) SELECT doc_id, a > 0 AND b * 2 < a AS truncated FROM x WHERE a IS NOT NULL")
def _(spark, d):
    from ..operators.ledger import lagged

    x = table(spark, d, "documents").select("doc_id", "source", F.octet_length("text").alias("b"))
    x = lagged(x, ["source"], ("doc_id",), F.call_function("div", C("doc_id"), F.lit(4096)), ["b"]).where("known_b is not null")
    return x.select("doc_id", S.is_truncated(C("known_b"), C("b")).alias("truncated"))


@q("storage_route", f"{FL} SELECT doc_id, CASE WHEN strlen(content) <= 4096 THEN 'inline' ELSE 'file' END AS route FROM files")
def _(spark, d):
    return files(spark, d).select("doc_id", S.storage_route(C("content"), 4096).alias("route"))


@q("window_extract", f"""{FL}, x AS (SELECT doc_id, content, string_split(content, chr(10)) AS ls, {LINES} AS n FROM files)
SELECT doc_id, CASE WHEN 2 > n THEN '' ELSE array_to_string(list_slice(ls, 2, least(4, n)), chr(10)) || CASE WHEN ends_with(content, chr(10)) OR 4 < n THEN chr(10) ELSE '' END END AS part FROM x""")
def _(spark, d):
    return files(spark, d).select("doc_id", S.window(C("content"), F.lit(2), F.lit(3)).alias("part"))


@q("language_of", r"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '\.([^./]+)$', 1)) AS e, url FROM pages) SELECT page_id, CASE WHEN e IN ('rs') THEN 'rust' WHEN e IN ('c', 'h') THEN 'c' WHEN e IN ('py', 'pyi') THEN 'python' WHEN e IN ('ts', 'tsx') THEN 'typescript' WHEN e IN ('go') THEN 'go' WHEN e IN ('cs') THEN 'csharp' ELSE 'generic' END AS language FROM p""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", S.language_of(C("url")).alias("language"))


HASHED = f"{FL}, h AS (SELECT doc_id, sha256(content) AS content_hash, strlen(content) AS bytes, length(content) AS chars, content FROM files)"


def hashed(spark, d):
    return files(spark, d).select("doc_id", S.content_hash(C("content")).alias("content_hash"), F.octet_length("content").cast("long").alias("bytes"), F.length("content").cast("long").alias("chars"))


@q("dedup_stats", f"{HASHED} SELECT count(*) AS rows_, count(DISTINCT content_hash) AS blobs, count(*) - count(DISTINCT content_hash) AS dedup FROM h")
def _(spark, d):
    return hashed(spark, d).agg(F.count("*").alias("rows_"), F.countDistinct("content_hash").alias("blobs")).withColumn("dedup", C("rows_") - C("blobs"))


@q("cache_stats", f"{HASHED}, b AS (SELECT content_hash, max(chars) AS chars, count(*) AS refs FROM h GROUP BY 1) SELECT count(*) AS blobs, CAST(sum(chars) AS BIGINT) AS stored_chars, CAST(sum(chars * refs) AS BIGINT) AS referenced_chars, CAST(max(refs) AS BIGINT) AS most_refs FROM b")
def _(spark, d):
    b = hashed(spark, d).groupBy("content_hash").agg(F.max("chars").alias("chars"), F.count("*").alias("refs"))
    return b.agg(F.count("*").alias("blobs"), F.sum("chars").alias("stored_chars"), F.sum(C("chars") * C("refs")).alias("referenced_chars"), F.max("refs").alias("most_refs"))


@q("compactable_rows", f"{HASHED} SELECT count(*) AS rows_, CAST(coalesce(sum(chars), 0) AS BIGINT) AS chars FROM h WHERE chars > 4096")
def _(spark, d):
    return hashed(spark, d).where("chars > 4096").agg(F.count("*").alias("rows_"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"))


@q("blob_store", f"{HASHED} SELECT content_hash, min(doc_id) AS first_doc, max(bytes) AS bytes FROM h GROUP BY 1")
def _(spark, d):
    return hashed(spark, d).groupBy("content_hash").agg(F.min("doc_id").alias("first_doc"), F.max("bytes").alias("bytes"))


ACTIVE = f"{HASHED}, a AS (SELECT content_hash FROM h WHERE doc_id IN (SELECT doc_id FROM labels) UNION SELECT sha256(text) FROM benchmark)"


def active(spark, d):
    live = hashed(spark, d).join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select("content_hash")
    return live.union(table(spark, d, "benchmark").select(S.content_hash(C("text")))).distinct()


@q("active_hashes", f"{ACTIVE} SELECT content_hash FROM a")
def _(spark, d):
    return active(spark, d)


@q("blob_orphans", f"{ACTIVE} SELECT DISTINCT content_hash FROM h WHERE content_hash NOT IN (SELECT content_hash FROM a)")
def _(spark, d):
    return hashed(spark, d).select("content_hash").distinct().join(active(spark, d), "content_hash", "left_anti")


@q("cache_gc", f"{ACTIVE}, b AS (SELECT content_hash, max(bytes) AS bytes FROM h GROUP BY 1) SELECT content_hash IN (SELECT content_hash FROM a) AS kept, count(*) AS blobs, CAST(sum(bytes) AS BIGINT) AS bytes FROM b GROUP BY 1")
def _(spark, d):
    b = hashed(spark, d).groupBy("content_hash").agg(F.max("bytes").alias("bytes"))
    m = b.join(active(spark, d).withColumn("kept", F.lit(True)), "content_hash", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    return m.groupBy("kept").agg(F.count("*").alias("blobs"), F.sum("bytes").alias("bytes"))


@q("doomed_hashes", f"{HASHED} SELECT content_hash FROM h WHERE doc_id NOT IN (SELECT doc_id FROM labels) EXCEPT SELECT content_hash FROM h WHERE doc_id IN (SELECT doc_id FROM labels)")
def _(spark, d):
    live = table(spark, d, "labels").select("doc_id")
    h = hashed(spark, d)
    return h.join(live, "doc_id", "left_anti").select("content_hash").subtract(h.join(live, "doc_id", "left_semi").select("content_hash"))


@q("blob_exists", f"{HASHED}, r AS (SELECT content_hash FROM h UNION ALL SELECT sha256(text) FROM benchmark) SELECT item_id, sha256(text) IN (SELECT content_hash FROM r) AS there FROM benchmark")
def _(spark, d):
    b = table(spark, d, "benchmark").select("item_id", S.content_hash(C("text")).alias("content_hash"))
    refs = hashed(spark, d).select("content_hash").unionAll(b.select("content_hash")).distinct().withColumn("there", F.lit(True))
    return b.join(refs, "content_hash", "left").select("item_id", F.coalesce("there", F.lit(False)).alias("there"))


@q("line_set_diff", f"""{FL}, l AS (SELECT doc_id, unnest(string_split(content, chr(10))) AS line FROM files),
o AS (SELECT doc_id, line, count(*) AS n FROM l GROUP BY 1, 2), p AS (SELECT doc_id + 1 AS doc_id, line, n FROM o WHERE doc_id + 1 IN (SELECT doc_id FROM files)), b AS (SELECT coalesce(o.doc_id, p.doc_id) AS doc_id, greatest(coalesce(o.n, 0) - coalesce(p.n, 0), 0) AS a, greatest(coalesce(p.n, 0) - coalesce(o.n, 0), 0) AS r FROM o FULL JOIN p ON o.doc_id = p.doc_id AND o.line = p.line)
SELECT doc_id, CAST(sum(a) AS BIGINT) AS added, CAST(sum(r) AS BIGINT) AS removed FROM b GROUP BY 1""")
def _(spark, d):
    f = files(spark, d)
    o = f.select("doc_id", F.explode(F.split("content", "\n", -1)).alias("line")).groupBy("doc_id", "line").agg(F.count("*").alias("n"))
    p = o.select((C("doc_id") + 1).alias("doc_id"), "line", C("n").alias("m")).join(f.select("doc_id"), "doc_id", "left_semi")
    b = o.join(p, ["doc_id", "line"], "full")
    n, m = F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0))
    return b.groupBy("doc_id").agg(F.sum(F.greatest(n - m, F.lit(0))).alias("added"), F.sum(F.greatest(m - n, F.lit(0))).alias("removed"))


KEY = "concat('host', CAST(conv_id % 7 AS VARCHAR))"


@q("session_key_hash", f"SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'given-' || conv_id WHEN conv_id % 2 = 0 THEN substr(sha256('git:' || {KEY} || ':main:'), 1, 16) ELSE substr(sha256('cwd:' || {KEY}), 1, 16) END AS session_key FROM conversations")
def _(spark, d):
    c = table(spark, d, "conversations")
    cwd = F.concat(F.lit("host"), (C("conv_id") % 7).cast("string"))
    env = F.when(C("role") == "system", F.concat(F.lit("given-"), C("conv_id").cast("string")))
    branch = F.when(C("conv_id") % 2 == 0, "main")
    return c.select("conv_id", "turn", S.session_key(env, branch, cwd, F.lit(None).cast("string")).alias("session_key"))


@q("agent_label", "SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'unknown' WHEN role = 'user' THEN 'anonymous' ELSE 'assistant' END AS agent FROM conversations")
def _(spark, d):
    raw = F.when(C("role") == "system", " ").when(C("role") == "user", "0a1b2c3d-0000-1111-2222-abcdefabcdef").otherwise(F.concat(F.lit(" "), F.upper("role")))
    return table(spark, d, "conversations").select("conv_id", "turn", S.agent_label(raw).alias("agent"))


@q("git_branch", "SELECT user_id, event_id, CASE event_id % 3 WHEN 0 THEN 'b' || user_id WHEN 1 THEN substr(sha256(CAST(user_id AS VARCHAR)), 1, 8) END AS branch FROM events")
def _(spark, d):
    head = F.when(C("event_id") % 3 == 0, F.concat(F.lit("ref: refs/heads/b"), C("user_id").cast("string"), F.lit("\n"))).when(C("event_id") % 3 == 1, F.sha2(C("user_id").cast("string"), 256)).otherwise("ref: x")
    return table(spark, d, "events").select("user_id", "event_id", S.git_branch(F.rtrim(F.replace(head, F.lit("\n"), F.lit(" ")))).alias("branch"))


SPAN = "CAST(event_id * 37 AS BIGINT)"


@q("humanisers", f"""SELECT event_id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm' WHEN s < 86400 THEN s // 3600 || 'h' ELSE s // 86400 || 'd' END AS age,
 CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm ' || s % 60 || 's' WHEN s < 86400 THEN s // 3600 || 'h ' || s % 3600 // 60 || 'm' ELSE s // 86400 || 'd ' || s % 86400 // 3600 || 'h' END AS duration,
 CASE WHEN s >= 1000000 THEN printf('%.1fM', floor(s / 1e5) / 10) WHEN s >= 1000 THEN printf('%.1fk', floor(s / 1e2) / 10) ELSE CAST(s AS VARCHAR) END AS compact,
 CASE WHEN s >= 1048576 THEN printf('%.1f MiB', floor(s / 104857.6) / 10) WHEN s >= 1024 THEN printf('%.1f KiB', floor(s / 102.4) / 10) ELSE s || ' B' END AS bytes FROM (SELECT event_id, {SPAN} AS s FROM events)""")
def _(spark, d):
    s = (C("event_id") * 37).cast("long")
    return table(spark, d, "events").select("event_id", S.format_age(s).alias("age"), S.format_duration(s).alias("duration"), S.format_compact(s).alias("compact"), S.format_bytes(s).alias("bytes"))


@q("bars_and_labels", """SELECT doc_id, repeat('#', n) || repeat('.', 20 - n) AS bar, CASE WHEN length(p) <= 8 THEN p ELSE '..' || right(p, 6) END AS tail, CASE WHEN length(p) <= 8 THEN p ELSE left(p, 6) || '..' END AS head
FROM (SELECT doc_id, source || '/' || lang AS p, CAST(floor(least(n_chars / 5000.0::DOUBLE, 1.0) * 20 + 0.5) AS INTEGER) AS n FROM documents)""")
def _(spark, d):
    p = F.concat_ws("/", "source", "lang")
    return table(spark, d, "documents").select("doc_id", S.bar(C("n_chars") / F.lit(5000.0)).alias("bar"), S.tail_label(p, 8).alias("tail"), S.head_label(p, 8).alias("head"))


@q("line_arguments", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(event_id AS INTEGER) WHEN 1 THEN CAST(event_id AS INTEGER) END AS line, event_id % 2 = 0 AS hash_ok FROM events")
def _(spark, d):
    e = C("event_id").cast("string")
    arg = F.when(C("event_id") % 3 == 0, e).when(C("event_id") % 3 == 1, F.concat(F.lit("L"), e)).otherwise(F.concat(e, F.lit("x")))
    h = F.when(C("event_id") % 2 == 0, F.sha2(e, 256)).otherwise(F.md5(e))
    return table(spark, d, "events").select("event_id", S.line_argument(arg).alias("line"), S.is_hash(h).alias("hash_ok"))


@q("fallback_labels", "SELECT event_type, CASE event_type WHEN 'error' THEN 'binary file' WHEN 'view' THEN 'diff is too complex' END AS label, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    reason = F.when(C("event_type") == "error", "binary").when(C("event_type") == "view", "too_complex")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", S.fallback_label(reason).alias("label"), "n")


@q("payload_fields", """SELECT event_id, 'f' || event_id AS path, CAST(json_extract_string(props, '$.k') AS INTEGER) AS offset_, CASE WHEN event_id % 2 = 0 THEN CAST(json_extract_string(props, '$.k') AS INTEGER) + 2000 END AS end_ FROM events""")
def _(spark, d):
    """Request payloads: a file, or else a notebook, and a window."""
    e = C("event_id").cast("string")
    k = F.get_json_object("props", "$.k")
    name = F.when(C("event_id") % 3 == 0, F.lit("notebook_path")).otherwise(F.lit("file_path"))
    limit = F.when(C("event_id") % 2 == 0, F.lit(',"limit":2000')).otherwise("")
    payload = F.concat(F.lit('{"tool_name":"Read","tool_input":{"'), name, F.lit('":"f'), e, F.lit('","offset":'), k, limit, F.lit("}}"))
    schema = "tool_name string, tool_input struct<file_path:string,notebook_path:string,offset:int,limit:int>"
    p = table(spark, d, "events").select("event_id", F.from_json(payload, schema).alias("p"))
    i = "p.tool_input."
    return p.select("event_id", F.coalesce(i + "file_path", i + "notebook_path").alias("path"), C(i + "offset").alias("offset_"), (C(i + "offset") + C(i + "limit")).alias("end_"))


@q("rpc_route", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN -32601 WHEN 3 THEN -32700 ELSE -32602 END AS code FROM events""")
def _(spark, d):
    """Line-delimited JSON-RPC: what each line is answered with (0: no error)."""
    e = C("event_id")
    line = (
        F.when(e % 5 == 0, '{"id":1,"method":"ping"}').when(e % 5 == 1, '{"id":1,"method":"tools/call","params":{"name":"read_file","arguments":{"file_path":"a"}}}')
        .when(e % 5 == 2, '{"id":1,"method":"nope"}').when(e % 5 == 3, "{nope").otherwise('{"id":1,"method":"tools/call","params":{"name":"read_file"}}')
    )
    rows = R.rpc(R.faults(table(spark, d, "events").select("event_id", line.alias("line"))))
    return rows.select("event_id", F.coalesce("code", F.lit(0)).alias("code"))


def asked(spark, d):
    """Lines of requests made from events: every method, errors of every kind, notifications."""
    e, n = C("event_id").cast("string"), C("event_id") % 9
    path = F.concat(F.lit("/w/f"), (C("event_id") % 50).cast("string"))
    call = lambda body: F.concat(F.lit('{"id":'), e, F.lit(',"method":"tools/call"'), body, F.lit("}"))
    line = (
        F.when(n == 0, F.concat(F.lit('{"id":"'), e, F.lit('","method":"ping"}'))).when(n == 1, call(F.concat(F.lit(',"params":{"name":"read_file","arguments":{"file_path":"'), path, F.lit('"}}'))))
        .when(n == 2, F.concat(F.lit('{"id":'), e, F.lit(',"method":"nope"}'))).when(n == 3, F.concat(F.lit("{nope "), e)).when(n == 4, call(F.lit(',"params":{"name":"read_file"}')))
        .when(n == 5, F.concat(F.lit('{"method":"'), e, F.lit('"}'))).when(n == 6, call(F.lit(""))).when(n == 7, F.concat(F.lit('{"id":'), e, F.lit(',"pad":"'), F.repeat(F.lit("x"), 300), F.lit('"}')))
        .otherwise(call(F.concat(F.lit(',"params":{"name":"tool'), e, F.lit('"}'))))
    )
    return table(spark, d, "events").select(C("event_id").alias("line_id"), line.alias("line"))


@q("rpc_replies", """WITH x AS (SELECT event_id, event_id % 9 AS n, event_id % 50 AS k FROM events), t AS (SELECT user_id % 50 AS k, count(*) AS c FROM events WHERE user_id % 50 < 40 GROUP BY 1)
SELECT event_id AS line_id, '{"jsonrpc":"2.0","id":' || CASE n WHEN 0 THEN '"' || event_id || '"' WHEN 3 THEN 'null' WHEN 7 THEN 'null' ELSE event_id || '' END || ',' || CASE n WHEN 0 THEN '"result":{}'
  WHEN 1 THEN '"result":{"content":[{"type":"text","text":"' || CASE WHEN c IS NULL THEN 'can''t be read: /w/f' || x.k ELSE c || ' events\\nof users \\"' || x.k || '\\"' END || '"}],"isError":' || CASE WHEN c IS NULL THEN 'true' ELSE 'false' END || '}'
  WHEN 2 THEN '"error":{"code":-32601,"message":"no such method"}' WHEN 3 THEN '"error":{"code":-32700,"message":"not JSON"}' WHEN 4 THEN '"error":{"code":-32602,"message":"no arguments"}'
  WHEN 6 THEN '"error":{"code":-32602,"message":"no params"}' WHEN 7 THEN '"error":{"code":-32600,"message":"a request is over 0 MiB"}' ELSE '"error":{"code":-32602,"message":"no such tool: tool' || event_id || '"}' END || '}' AS reply
FROM x LEFT JOIN t USING (k) WHERE n <> 5""")
def _(spark, d):
    """Replies to a log of requests, with a cap of 256 bytes a line."""
    from dataclasses import replace

    config = replace(DEFAULT, payload_max_bytes=256)
    k = C("user_id") % 50
    told = table(spark, d, "events").where(k < 40).groupBy(k.alias("k")).agg(F.count("*").alias("c"))
    text = F.concat(C("c").cast("string"), F.lit(' events\nof users "'), C("k").cast("string"), F.lit('"'))
    answers = told.select(F.concat(F.lit("/w/f"), C("k").cast("string")).alias("file_path"), text.alias("text"))
    return R.replies(R.rpc(R.faults(asked(spark, d), config), config), answers, "/w", config).select("line_id", "reply")


@q("hook_actions", f"""WITH x AS (SELECT event_id, event_id % 10 AS n, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id AS line_id, CASE n WHEN 3 THEN 'r' WHEN 8 THEN 'dflt' ELSE 's' || event_id % 7 END AS session_id,
  CASE WHEN n IN (0, 1, 4, 5, 7) THEN 'src/f' || k || '.txt' END AS file_path,
  CASE n WHEN 0 THEN 'read' WHEN 1 THEN 'partial' WHEN 2 THEN CASE WHEN event_id % 3 = 0 THEN 'reset' END WHEN 3 THEN 'reset' WHEN 4 THEN 'edit' WHEN 5 THEN 'guard' WHEN 6 THEN 'grep' WHEN 7 THEN 'read' WHEN 8 THEN 'glob' END AS action,
  CASE WHEN n = 1 THEN greatest(k, 1) END AS win_start, CASE WHEN n = 1 THEN greatest(k, 1) + CASE WHEN event_id % 2 = 0 THEN 9 ELSE 1999 END END AS win_end,
  CAST(CASE n WHEN 4 THEN 2 WHEN 5 THEN 1 ELSE 0 END AS INTEGER) AS edits, CASE WHEN n IN (6, 8) THEN 'p' || k END AS pattern, CAST(CASE WHEN n IN (6, 8) THEN CASE n WHEN 6 THEN 3 ELSE 0 END END AS BIGINT) AS after, n = 9 AS malformed
FROM (SELECT *, event_id % 3 FROM x)""")
def _(spark, d):
    """Payloads of all eight kinds, and malformed ones, made from events."""
    n, s, k = C("event_id") % 10, F.concat(F.lit('"session_id":"s'), (C("event_id") % 7).cast("string"), F.lit('"')), F.get_json_object("props", "$.k")
    path = F.concat(F.lit('"src/f'), k, F.lit('.txt"'))
    wrap = lambda tool, *inner: F.concat(F.lit("{"), s, F.lit(f',"tool_name":"{tool}","tool_input":{{'), *inner, F.lit("}}"))
    limit = F.when(C("event_id") % 2 == 0, F.lit(',"limit":10')).otherwise(F.lit(""))
    line = (
        F.when(n == 0, wrap("Read", F.lit('"file_path":'), path)).when(n == 1, wrap("Read", F.lit('"file_path":'), path, F.lit(',"offset":'), k, limit))
        .when(n == 2, F.concat(F.lit("{"), s, F.lit(',"source":"'), F.get(F.lit(["compact", "startup", "other"]), (C("event_id") % 3).cast("int")), F.lit('"}'))).when(n == 3, F.lit('{"sessionId":"r"}'))
        .when(n == 4, wrap("MultiEdit", F.lit('"file_path":'), path, F.lit(',"edits":[{"old_string":"a","new_string":"b"},{"old_string":"c","new_string":""}]')))
        .when(n == 5, wrap("NotebookEdit", F.lit('"notebook_path":'), path, F.lit(',"new_string":"x"'))).when(n == 6, wrap("Grep", F.lit('"pattern":"p'), k, F.lit('","-C":3,"-i":true')))
        .when(n == 7, F.concat(F.lit("{"), s, F.lit(',"file_path":'), path, F.lit("}"))).when(n == 8, F.concat(F.lit('{"tool_name":"Glob","tool_input":{"pattern":"p'), k, F.lit('"}}')))
        .otherwise(F.concat(F.lit("{"), s))
    )
    hooks = F.lit(["read", "read", "session_start", "compress", "post_edit", "pre_edit", "grep", "plain_read", "glob", "read"])
    rows = table(spark, d, "events").select(C("event_id").alias("line_id"), F.get(hooks, n.cast("int")).alias("hook"), line.alias("line"), (C("event_id") % 7).alias("g"))
    out = R.payloads(R.faults(rows), "dflt")
    session = F.when(C("malformed"), F.concat(F.lit("s"), C("g").cast("string"))).otherwise(C("session_id"))
    return out.select(
        "line_id", session.alias("session_id"), "file_path", "action", "win_start", "win_end", F.coalesce(F.size("edits"), F.lit(0)).alias("edits"),
        C("search.pattern").alias("pattern"), C("search.after").alias("after"), "malformed",
    )


@q("content_round_trip", "SELECT doc_id, sha256(text) AS content_hash, CAST(strlen(text) AS BIGINT) AS n_bytes, strlen(text) % 3 <> 0 AS kept FROM documents")
def _(spark, d):
    """All texts written to a store by their hash, twice, the store compacted, some contents removed, and each document read back."""
    store = ContentStore(spark, Scratch(spark, "store").root + "/contents", 1)
    own = files(spark, d).select("doc_id", C("content"), S.content_hash(C("content")).alias("content_hash"))
    odd = C("doc_id") % 2 == 0
    store.add(own.where(odd))
    store.add(own)
    store.compact()
    store.remove(own.where(F.octet_length("content") % 3 == 0))
    # what is read back is known by its own hash; of contents no more than their sizes meet
    back = store.read().select(S.content_hash(C("content")).alias("content_hash"), F.octet_length("content").alias("back"))
    both = own.select("doc_id", "content_hash", F.octet_length("content").alias("n")).join(back, "content_hash", "left")
    return both.select("doc_id", "content_hash", F.coalesce("back", "n").cast("long").alias("n_bytes"), C("back").isNotNull().alias("kept"))


@q("hook_responses", f"""{CLASSIFIED} SELECT action_id, CASE WHEN outcome IN ('unchanged', 'delta') THEN '{{"decision":"deny","reason":"' || outcome || ' ' || file_path || '"}}' ELSE '{{"decision":"allow"}}' END AS response FROM classified WHERE kind = 'read'""")
def _(spark, d):
    """Decisions as JSON: a substituted read is denied with its text, others are allowed."""
    from ..operators import ledger as L

    c = L.classified(actions(spark, d)).where("kind = 'read'")
    served = C("outcome").isin("unchanged", "delta")
    body = F.struct(F.when(served, "deny").otherwise("allow").alias("decision"), F.when(served, F.concat_ws(" ", "outcome", "file_path")).alias("reason"))
    return c.select("action_id", F.to_json(body).alias("response"))


@q("chrono_day", f"WITH {ACTIONS_SQL} SELECT action_id, strftime(make_timestamp(occurred_at * 1000000), '%Y-%m-%d') AS day FROM actions")
def _(spark, d):
    return actions(spark, d).select("action_id", S.day_of(C("occurred_at")).alias("day"))


@q("utf8_cut", f"{FL} SELECT doc_id, CASE WHEN strlen(content) <= 100 THEN content ELSE substr(content, 1, list_max(list_filter(range(0, 101), lambda k: strlen(substr(content, 1, k)) <= 100))) || '...' END AS cut FROM files")
def _(spark, d):
    return files(spark, d).select("doc_id", S.utf8_cut(C("content"), 100, "...").alias("cut"))


@q("cross_file_rollup", "SELECT source, lang, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY 1, 2")
def _(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
