"""Requests as lines: malformed, oversized and odd ones against replies written by hand; payloads."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerspark.config import LedgerConfig
from ledgerspark.operators import search as G
from ledgerspark.sources import requests as R

CALL = '{"id":%s,"method":"tools/call","params":{"name":"read_file","arguments":{"file_path":"%s"}}}'


def error(id_, code, message):
    return {"jsonrpc": "2.0", "id": id_, "error": {"code": code, "message": message}}


def content(id_, text, failed=False):
    return {"jsonrpc": "2.0", "id": id_, "result": {"content": [{"type": "text", "text": text}], "isError": failed}}


def test_replies(spark, tmp_path):
    """A file of requests, some of which are no text at all, and the file of replies."""
    lines = [
        (b'{"id":1,"method":"ping"}', {"jsonrpc": "2.0", "id": 1, "result": {}}), (b"", None), (b"  ", None), (b"{nope", error(None, -32700, "not JSON")),
        (b'{"method":"ping"}', None), (b'{"id":null,"method":"x"}', None), (b'[{"id":1,"method":"ping"}]', None), (b"7", None), (b'{"id":2.5,"method":"nope"}', error(2.5, -32601, "no such method")),
        (b'{"id":3,"method":7}', error(3, -32601, "no such method")), (b'{"id":"q\\"","method":"tools/call"}', error('q"', -32602, "no params")),
        (b'{"id":5,"method":"tools/call","params":{"name":4}}', error(5, -32602, "no tool")), (b'{"id":5,"method":"tools/call","params":{"name":"x"}}', error(5, -32602, "no such tool: x")),
        (b'{"id":6,"method":"tools/call","params":{"name":"read_file"}}', error(6, -32602, "no arguments")),
        (b'{"id":7,"method":"tools/call","params":{"name":"read_file","arguments":{"file_path":9}}}', error(7, -32602, "no file_path")),
        ((CALL % (8, "/w/a")).encode(), content(8, 'he said "é"\n')), ((CALL % (9, "/w/../b")).encode(), content(9, "refused, outside of the workspace: /w/../b", True)),
        ((CALL % (10, "/wb")).encode(), content(10, "refused, outside of the workspace: /wb", True)), ((CALL % (11, "/w/c")).encode(), content(11, "can't be read: /w/c", True)),
        (b'{"id":"\xff"}', error(None, -32700, "a request is not UTF-8")), (b'{"id":12,"pad":"' + b"x" * (1 << 20) + b'"}', error(None, -32600, "a request is over 1 MiB")),
        (b'{"id":13,"method":"ping","pad":"' + b"x" * 1000 + b'"}', {"jsonrpc": "2.0", "id": 13, "result": {}}),
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_bytes(b"\n".join(line for line, _ in lines) + b"\n")
    config = LedgerConfig(payload_max_bytes=1 << 20)
    answers = spark.createDataFrame([("/w/a", 'he said "é"\n'), ("/w/../b", "x"), ("/wb", "x")], "file_path string, text string")
    R.write_replies(R.replies(R.rpc(R.request_lines(spark, str(tmp_path / "in"), config), config), answers, "/w", config), str(tmp_path / "out"))
    got = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    order = lambda rows: sorted(json.dumps(r, sort_keys=True) for r in rows)
    assert order(got) == order(r for _, r in lines if r)


def test_about_and_tools(spark):
    df = spark.createDataFrame([(1, '{"id":1,"method":"initialize"}'), (2, '{"id":[2],"method":"tools/list"}')], "line_id long, line string")
    none = spark.createDataFrame([], "file_path string, text string")
    a, b = (json.loads(r.reply) for r in R.replies(R.rpc(R.faults(df)), none).orderBy("line_id").collect())
    assert a["result"]["capabilities"] == {"tools": {}} and b["id"] == [2] and b["result"]["tools"][0]["inputSchema"]["required"] == ["file_path"]


PAYLOADS = [
    ("read", {"session_id": "s", "tool_name": "Read", "tool_input": {"file_path": "a"}}, ("s", "a", "read", None, None)),
    ("read", {"session_id": "s", "tool_name": "Read", "tool_input": {"file_path": "a", "offset": 5}}, ("s", "a", "partial", 5, 2004)),
    ("read", {"tool_name": "Read", "tool_input": {"file_path": "a", "limit": 3, "offset": 0}}, ("given", "a", "partial", 1, 3)),
    ("read", {"session_id": "", "tool_name": "Read", "tool_input": {"file_path": "a", "offset": "5"}}, ("given", "a", "read", None, None)),
    ("read", {"session_id": "s", "tool_name": "Other", "tool_input": {"file_path": "a"}}, ("s", "a", None, None, None)),
    ("read", {"session_id": "s", "tool_name": "Read"}, ("s", None, None, None, None)),
    ("plain_read", {"file_path": "b"}, ("given", "b", "read", None, None)),
    ("post_edit", {"session_id": "s", "tool_name": "Edit", "tool_input": {"file_path": "a", "old_string": "x", "new_string": "y"}}, ("s", "a", "edit", None, None)),
    ("post_edit", {"session_id": "s", "tool_name": "NotebookEdit", "tool_input": {"notebook_path": "n"}}, ("s", "n", "edit", None, None)),
    ("post_edit", {"session_id": "s", "tool_name": "Read", "tool_input": {"file_path": "a"}}, ("s", "a", None, None, None)),
    ("pre_edit", {"session_id": "s", "tool_name": "MultiEdit", "tool_input": {"file_path": "a", "edits": [{"old_string": "1", "new_string": "2"}, {"old_string": "3"}]}}, ("s", "a", "guard", None, None)),
    ("session_start", {"session_id": "s", "source": "clear"}, ("s", None, "reset", None, None)), ("session_start", {"session_id": "s", "source": "startup"}, ("s", None, None, None, None)),
    ("compress", {"sessionId": "c"}, ("c", None, "reset", None, None)), ("compress", {"session_id": "d", "sessionId": "c"}, ("d", None, "reset", None, None)),
    ("compress", "", ("given", None, "reset", None, None)), ("session_start", {"sessionId": "c", "source": "resume"}, ("given", None, "reset", None, None)),
    ("glob", {"session_id": "s", "tool_name": "Glob", "tool_input": {"pattern": "*.rs"}}, ("s", None, "glob", None, None)),
    ("grep", {"session_id": "s", "tool_name": "Grep", "tool_input": {"pattern": "x", "-i": True, "-B": 1, "-C": 2, "type": "py", "output_mode": "content", "head_limit": 9}}, ("s", None, "grep", None, None)),
    ("read", "{nope", ("given", None, None, None, None)), ("compress", "{nope", ("given", None, None, None, None)),
]


def test_payloads(spark):
    rows = [(i, hook, p if isinstance(p, str) else json.dumps(p)) for i, (hook, p, _) in enumerate(PAYLOADS)]
    got = {r.line_id: r for r in R.payloads(R.faults(spark.createDataFrame(rows, "line_id long, hook string, line string")), "given").collect()}
    assert {hook for hook, _, _ in PAYLOADS} == set(R.KINDS)
    for i, (_, p, want) in enumerate(PAYLOADS):
        r = got[i]
        assert (r.session_id, r.file_path, r.action, r.win_start, r.win_end) == want, PAYLOADS[i]
        assert r.malformed == (p == "{nope")
    assert [tuple(e) for e in got[7].edits] == [("x", "y")] and [tuple(e) for e in got[10].edits] == [("1", "2"), ("3", None)] and got[8].edits is None
    s = got[18].search
    assert (s.pattern, s.path, s.type, s.mode, s.ignore_case, s.numbers, s.before, s.after, s.head_limit) == ("x", ".", "py", "content", True, False, 1, 2, 9)
    assert got[17].search.mode == "files_with_matches" and got[0].search is None


def test_decisions_and_what_the_ledger_takes_in(spark):
    rows = [
        (1, "read", '{"tool_name":"Read","tool_input":{"file_path":"a"}}', "unchanged", "[same]"), (2, "read", '{"tool_name":"Read","tool_input":{"file_path":"a"}}', "external", "changed"),
        (3, "read", '{"tool_name":"Read","tool_input":{"file_path":"node_modules/x"}}', "first", None), (4, "pre_edit", '{"tool_name":"Edit","tool_input":{"file_path":"a"}}', None, "elided"),
        (5, "compress", "", None, None), (6, "read", "{nope", "unchanged", "x"), (7, "post_edit", '{"tool_name":"Edit","tool_input":{"file_path":".env"}}', None, None),
    ]
    asked = R.payloads(R.faults(spark.createDataFrame(rows, "line_id long, hook string, line string, outcome string, text string")), "s")
    got = {r.line_id: json.loads(r.response) for r in R.decisions(asked).collect()}
    body = lambda decision, **more: {"hookSpecificOutput": {"hookEventName": "PreToolUse", "permissionDecision": decision, **more}}
    assert got == {
        1: body("deny", permissionDecisionReason="[same]"), 2: body("allow", additionalContext="changed"), 3: body("allow"), 4: body("deny", permissionDecisionReason="elided"),
        5: {}, 6: body("allow"), 7: {},
    }
    assert {r.line_id for r in R.edit_actions(asked).collect()} == {1, 2, 5}


def test_types_and_pass_through(spark):
    files = spark.createDataFrame([("a.py", "x\nhit\n"), ("b.RS", "hit"), ("c/py", "hit"), (".py", "hit"), ("node_modules/a.py", "gone")], "path string, content string").withColumn("g", F.lit(1))
    assert {r.path for r in G.grep_content(files, "hit", type="py").collect()} == {"a.py"} and {r.path for r in G.grep_content(files, "hit", type="rust").collect()} == {"b.RS"}
    with pytest.raises(ValueError):
        G.of_type(F.lit("a"), "nope")
    told = lambda pattern, **o: tuple(G.pass_through(files, pattern, ["g"], **o).first())[1:]
    assert told("hit") == (4, 0, False) and told("gone") == (0, 1, False) and told("never") == (0, 0, True) and told("never", forced=True) == (0, 0, False)
    text = [r.text for r in G.numbered(G.grep_content(files.where("path = 'a.py'"), "hit", before=1), numbers=True).orderBy("line_no").collect()]
    assert text == ["a.py-1-x", "a.py:2:hit"]
