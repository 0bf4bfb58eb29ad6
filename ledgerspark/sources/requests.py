"""Requests as lines of JSON, in and out: JSON-RPC, and the payloads of an agent's hooks.

Lines are read by tasks, many to a file. A line over ``cap`` bytes, or that isn't UTF-8, or not
JSON, is kept with its fault in place of its text and is answered with it; nothing stops the
others. Everything here is column expressions over a frame with a ``line``.

RPC: a line without an id, or with a null one, is a notification and has no reply; an empty line
has none either. Hooks: eight kinds of payload; which one a line is of is told beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, LedgerConfig
from ..functions.ignore import is_ignored

#: Codes of JSON-RPC 2.0.
PARSE, INVALID, METHOD, PARAMS = -32700, -32600, -32601, -32602
TOOL = "read_file"
#: Tools that write, and what a session may start from that forgets what it was sent (fixed values).
WRITES = ("Edit", "Write", "MultiEdit", "NotebookEdit")
RESETS = ("compact", "clear", "resume")
KINDS = ("read", "glob", "grep", "post_edit", "pre_edit", "session_start", "plain_read", "compress")


def request_lines(spark: SparkSession, folder: str, config: LedgerConfig = DEFAULT) -> DataFrame:
    """``line_id`` (in the order of each file), ``line``, ``fault`` (``too_long``, ``not_utf8``)."""
    rows = spark.read.text(folder).select(F.monotonically_increasing_id().alias("line_id"), F.col("value").alias("line"))
    return faults(rows, config)


def faults(rows: DataFrame, config: LedgerConfig = DEFAULT) -> DataFrame:
    """``rows`` with the ``fault`` of each ``line``, and no text where there is one."""
    fault = F.when(F.octet_length("line") > config.payload_max_bytes, "too_long").when(~F.is_valid_utf8("line"), "not_utf8")
    return rows.withColumn("fault", fault).withColumn("line", F.when(F.col("fault").isNull(), F.col("line")))


def _get(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def _text(value: Column, path: str) -> Column:
    """A string in a variant; null if there is something else."""
    own = _get(value, path)
    return F.when(F.schema_of_variant(own) == "STRING", F.try_variant_get(value, path, "string"))


def _integer(value: Column, path: str) -> Column:
    own = F.when(F.schema_of_variant(_get(value, path)) == "BIGINT", F.try_variant_get(value, path, "long"))
    return F.when(own >= 0, own)


def rpc(rows: DataFrame, config: LedgerConfig = DEFAULT) -> DataFrame:
    """:func:`faults`'s rows with ``id`` (as JSON), ``method``, ``file_path``, and the ``code`` and
    ``message`` of an error; lines that are answered only."""
    v = F.try_parse_json("line")
    empty = F.trim(F.coalesce("line", F.lit("x"))) == ""
    known = rows.where(~empty).withColumn("v", v)
    own = _get(F.col("v"), "$.id")
    named = known.withColumns({"id": F.when(own.isNotNull() & ~F.is_variant_null(own), F.to_json(own)), "method": _text(F.col("v"), "$.method")})
    named = named.where(F.col("fault").isNotNull() | F.col("v").isNull() | F.col("id").isNotNull())
    call, tool = F.col("method") == "tools/call", _text(F.col("v"), "$.params.name")
    path = _text(F.col("v"), "$.params.arguments.file_path")
    lacks = lambda part: _get(F.col("v"), part).isNull()
    wrong = (
        F.when(lacks("$.params"), "no params").when(tool.isNull(), "no tool").when(tool != TOOL, F.concat(F.lit("no such tool: "), tool))
        .when(lacks("$.params.arguments"), "no arguments").when(path.isNull(), "no file_path")
    )
    megabytes = config.payload_max_bytes >> 20
    code = (
        F.when(F.col("fault") == "too_long", INVALID).when(F.col("fault").isNotNull() | F.col("v").isNull(), PARSE)
        .when(call & wrong.isNotNull(), PARAMS).when(call | F.coalesce(F.col("method").isin("initialize", "tools/list", "ping"), F.lit(False)), F.lit(None)).otherwise(METHOD)
    )
    message = (
        F.when(F.col("fault") == "too_long", f"a request is over {megabytes} MiB").when(F.col("fault") == "not_utf8", "a request is not UTF-8")
        .when(F.col("v").isNull(), "not JSON").when(code == PARAMS, wrong).when(code == METHOD, "no such method")
    )
    return named.withColumns({"code": code, "message": message, "file_path": F.when(call, path)}).drop("v")


def replies(requests: DataFrame, answers: DataFrame, root: str | None = None, config: LedgerConfig = DEFAULT) -> DataFrame:
    """:func:`rpc`'s rows with ``reply``, a line of JSON. ``answers`` has one ``text`` a ``file_path``
    (null if it can't be read); a file outside of ``root`` is refused, and so is a path with ``..``."""
    told = requests.join(answers.select("file_path", "text", F.lit(True).alias("there")), "file_path", "left")
    inside = F.lit(True) if root is None else F.startswith("file_path", F.lit(root.rstrip("/") + "/")) & ~F.rlike("file_path", F.lit(r"(^|/)\.\.(/|$)"))
    failed = F.when(~inside, F.concat(F.lit("refused, outside of the workspace: "), "file_path")).when(F.col("text").isNull(), F.concat(F.lit("can't be read: "), "file_path"))
    content = F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), F.coalesce(failed, F.col("text")).alias("text"))).alias("content"), failed.isNotNull().alias("isError")))
    about = F.lit(f'{{"protocolVersion":"2024-11-05","capabilities":{{"tools":{{}}}},"serverInfo":{{"name":"{config.tag}","version":"1"}}}}')
    tools = F.lit(
        f'{{"tools":[{{"name":"{TOOL}","description":"A file, or what changed in it.","inputSchema":{{"type":"object","properties":{{"file_path":{{"type":"string"}}}},'
        '"required":["file_path"],"additionalProperties":false}}]}'
    )
    result = F.when(F.col("method") == "initialize", about).when(F.col("method") == "tools/list", tools).when(F.col("method") == "ping", "{}").otherwise(content)
    error = F.to_json(F.struct("code", "message"))
    body = F.when(F.col("code").isNotNull(), F.concat(F.lit('"error":'), error)).otherwise(F.concat(F.lit('"result":'), result))
    line = F.concat(F.lit('{"jsonrpc":"2.0","id":'), F.coalesce("id", F.lit("null")), F.lit(","), body, F.lit("}"))
    return told.withColumn("reply", line).drop("text", "there")


def write_replies(told: DataFrame, folder: str) -> None:
    """Replies as lines, in the order of their requests within each file."""
    told.repartitionByRange("line_id").sortWithinPartitions("line_id").select("reply").write.mode("overwrite").text(folder)


def payloads(rows: DataFrame, session_id: str | None = None) -> DataFrame:
    """:func:`faults`'s rows with a ``hook`` (one of KINDS), and what their payload asks for:
    ``session_id`` (in either spelling, else the one given), ``file_path`` (or a notebook's),
    ``action`` (``read``, ``partial``, ``edit``, ``reset``, ``glob``, ``grep``, ``guard``; null: nothing
    to do), ``win_start, win_end``, ``edits`` (replaced and new texts), ``search`` (a pattern
    and its options) and ``malformed``."""
    v = F.try_parse_json("line")
    rows = rows.withColumn("v", F.when((F.col("hook") == "compress") & (F.trim(F.coalesce("line", F.lit("x"))) == ""), F.parse_json(F.lit("{}"))).otherwise(v))
    v, given = F.col("v"), lambda c: F.when(c != "", c)
    session = F.coalesce(given(_text(v, "$.session_id")), F.when(F.col("hook") == "compress", given(_text(v, "$.sessionId"))), F.lit(session_id).cast("string"))
    tool, hook = _text(v, "$.tool_name"), F.col("hook")
    of = lambda name: _text(v, f"$.tool_input.{name}")
    path = F.when(hook == "plain_read", _text(v, "$.file_path")).otherwise(F.coalesce(of("file_path"), F.when(hook.isin("post_edit", "pre_edit"), of("notebook_path"))))
    offset, limit = _integer(v, "$.tool_input.offset"), _integer(v, "$.tool_input.limit")
    window = offset.isNotNull() | limit.isNotNull()
    start = F.greatest(F.coalesce(offset, F.lit(1)), F.lit(1))
    action = (
        F.when((hook == "read") & (tool == "Read") & path.isNotNull(), F.when(window, "partial").otherwise("read"))
        .when((hook == "plain_read") & path.isNotNull(), "read")
        .when(hook.isin("post_edit", "pre_edit") & tool.isin(*WRITES) & path.isNotNull(), F.when(hook == "post_edit", "edit").otherwise("guard"))
        .when((hook == "session_start") & _text(v, "$.source").isin(*RESETS), "reset").when((hook == "compress") & v.isNotNull(), "reset")
        .when((hook == "glob") & (tool == "Glob") & of("pattern").isNotNull(), "glob").when((hook == "grep") & (tool == "Grep") & of("pattern").isNotNull(), "grep")
    )
    pair = "old_string string, new_string string"
    many = F.try_variant_get(v, "$.tool_input.edits", f"array<struct<{pair.replace(' string', ':string')}>>")
    one = F.array(F.struct(of("old_string").alias("old_string"), of("new_string").alias("new_string")))
    edits = F.when(hook.isin("post_edit", "pre_edit"), F.coalesce(many, F.when(of("old_string").isNotNull() | of("new_string").isNotNull(), one)))
    flag = lambda name: F.coalesce(F.try_variant_get(v, f"$.tool_input['{name}']", "boolean"), F.lit(False))
    number = lambda name: _integer(v, f"$.tool_input['{name}']")
    search = F.when(hook.isin("glob", "grep") & of("pattern").isNotNull(), F.struct(
        of("pattern").alias("pattern"), F.coalesce(of("path"), F.lit(".")).alias("path"), of("glob").alias("glob"), of("type").alias("type"),
        F.coalesce(of("output_mode"), F.lit("files_with_matches")).alias("mode"), flag("-i").alias("ignore_case"), flag("-n").alias("numbers"), flag("multiline").alias("multiline"),
        F.coalesce(number("-B"), number("-C"), F.lit(0)).alias("before"), F.coalesce(number("-A"), number("-C"), F.lit(0)).alias("after"), number("head_limit").alias("head_limit"),
    ))
    return rows.withColumns({
        "malformed": v.isNull(), "session_id": session, "action": action, "file_path": path,
        "win_start": F.when(action == "partial", start), "win_end": F.when(action == "partial", start + F.coalesce(limit, F.lit(DEFAULT.window_lines)) - 1),
        "edits": edits, "search": search,
    }).drop("v")


def decisions(asked: DataFrame) -> DataFrame:
    """:func:`payloads`'s rows with an ``outcome`` and a ``text`` (both may be null): ``response``, JSON.

    What is told in place of a file denies the read with its text; a read that goes through is
    allowed, with a notice where the file changed from outside (``external``); a guarded edit
    is denied with its warning; a search whose result came out different is denied with it."""
    body = lambda decision, **more: F.to_json(F.struct(F.struct(F.lit("PreToolUse").alias("hookEventName"), F.lit(decision).alias("permissionDecision"), *(c.alias(k) for k, c in more.items())).alias("hookSpecificOutput")))
    told = F.col("text").isNotNull() & ~F.col("malformed") & F.col("action").isNotNull()
    notice = told & (F.col("outcome") == "external")
    return asked.withColumn("response", (
        F.when(F.col("hook").isin("session_start", "compress", "post_edit"), "{}").when(notice, body("allow", additionalContext=F.col("text")))
        .when(told, body("deny", permissionDecisionReason=F.col("text"))).otherwise(body("allow"))
    ))


def edit_actions(asked: DataFrame) -> DataFrame:
    """The edits and reads that the ledger takes in: not of ignored files, not malformed ones."""
    return asked.where(F.col("action").isin("read", "partial", "edit", "reset") & ~F.col("malformed") & (F.col("file_path").isNull() | ~is_ignored(F.col("file_path"))))
