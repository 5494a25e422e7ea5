"""Stores, files, discovery, history, hook, receiver, tail, sinks, settings and commands on things made here."""

import http.client
import io
import json
import os
import sqlite3
import subprocess

import duckdb
import pytest
import zstandard
from pyspark.sql import functions as F

from turnstone import cli, config, sinks
from turnstone.functions import text as T
from turnstone.operators import commits as M
from turnstone.operators import events as E
from turnstone.operators import nodes as N
from turnstone.operators import normalize as NZ
from turnstone.operators import transcript as O
from turnstone.plans import formats
from turnstone.plans.formats import FORMATS
from turnstone.sources import commits as G
from turnstone.sources import discover as P
from turnstone.sources import hook, otlp, stores
from turnstone.sources.lines import read_documents, read_lines
from turnstone.streaming import tail as TL

RAW = "run_id string, line_no long, byte_offset long, line string"
# Input that no normalizer may break on.
ODD = [
    "", "   ", "plain words", "\x00\x01", '{"a":', "[1,2", '"lone', '{"type":"user",}', "[" * 2000 + "]" * 2000, '{"a":' * 500 + "1" + "}" * 500, "9" * 400, "1e400", "0." + "1" * 500,
    '{"timestamp":"9999999-01-01T00:00:00Z","type":"user"}', '{"timestamp":99999999999999999999}', '{"type":5,"message":[],"uuid":{}}', '{"type":"user","message":{"content":7}}', '{"role":3,"kind":[]}', '{"kind":"session_start","git":7,"cwd":1}',
    '{"role":"user","toolCalls":{},"edits":[1,null,"x",{"path":3}]}', '{"type":"response_item","payload":[]}', '{"type":"event_msg","payload":{"type":"patch_apply_end","changes":[1]}}', '{"$set":null}', '{"$rewindTo":{"x":1}}',
    '{"attributes":[1,{"key":3},{"key":"a"}]}', '{"gen_ai.operation.name":"execute_tool"}', '{"requests":[1,{"message":3,"response":[4,{"kind":"text"}]}]}', "x" * 50_000, "null", "true", "3", '"text"', "[]", "{}", '{"a":"\\ud800"}',
]


@pytest.mark.parametrize("tool", ["claude_code", "codex", "gemini", "otel", "cursor", "vscode", "hermes"])
def test_odd_input_is_kept(spark, tool):
    rows = [("f", i + 1, 0, x) for i, x in enumerate(ODD)]
    raw = spark.createDataFrame(rows, RAW)
    got = NZ.normalize(raw, tool).collect()
    lines = {r.provenance.line_no for r in got}
    # Codex takes JSON only. A record that is kept but says nothing, such as a session without requests, gives no event.
    must = {i for i, x in enumerate(ODD, 1) if x.strip() and not (tool == "codex" and x[:1] not in '{[t"n39')}
    lost = [ODD[i - 1][:60] for i in must - lines]
    assert len(lost) <= 9, lost
    assert sorted(r.seq for r in got) == sorted({r.seq for r in got})


def write_db(path, *statements):
    db = sqlite3.connect(path)
    for s in statements:
        db.execute(*s) if isinstance(s, tuple) else db.execute(s)
    db.commit()
    db.close()
    return str(path)


def kinds(events):
    return [(r.session_id, r.kind, r.text, r.call_id, r.ok, r.path) for r in events.orderBy("run_id", "seq").collect()]


def test_cursor_store(spark, tmp_path):
    bubble = lambda **x: json.dumps(x)
    path = write_db(
        tmp_path / "state.vscdb", "CREATE TABLE cursorDiskKV (key TEXT, value BLOB)",
        ("INSERT INTO cursorDiskKV VALUES ('composerData:c1', ?)", (json.dumps({"composerId": "c1", "createdAt": 1700000000000, "fullConversationHeadersOnly": [{"bubbleId": "b2"}, {"bubbleId": "b1"}]}),)),
        ("INSERT INTO cursorDiskKV VALUES ('composerData:x', 'no json')",),
        ("INSERT INTO cursorDiskKV VALUES ('bubbleId:c1:b1', ?)", (bubble(type="2", text="done", toolFormerData={"name": "edit_file_v2", "toolCallId": "t", "rawArgs": '{"path":"a.rs","streamContent":"z"}', "status": "error", "result": "{}"}).encode(),)),
        ("INSERT INTO cursorDiskKV VALUES ('bubbleId:c1:b2', ?)", (bubble(type=1, richText="use X"),)),
        ("INSERT INTO cursorDiskKV VALUES ('bubbleId:c1:b3', ?)", (bubble(type=9, createdAt="2024-01-01T00:00:00Z"),)),
        ("INSERT INTO cursorDiskKV VALUES ('bubbleId:c11:b4', ?)", (bubble(type=1, text="other chat"),)),
    )
    got = kinds(NZ.cursor(stores.cursor(spark, [path, str(tmp_path / "none.vscdb")])))
    assert got == [("c1", "session_start", None, None, None, None), ("c1", "user_turn", "use X", None, None, None), ("c1", "assistant_turn", "done", None, None, None), ("c1", "tool_call", None, "t", None, None), ("c1", "tool_result", None, "t", False, None), ("c1", "file_edit", None, "t", None, "a.rs"), ("c1", "unknown", None, None, None, None)]


def test_vscode_store(spark, tmp_path):
    session = {"sessionId": "v", "creationDate": 1700000000000, "responderUsername": "R", "requests": [{"requestId": "q", "message": {"text": "use X"}, "response": [{"value": "ok"}, {"kind": "markdownContent", "content": {"value": "then"}}, {"kind": "toolInvocationSerialized", "toolCallId": "t", "toolId": "run"}, {"kind": "textEditGroup", "uri": {"path": "/a.py"}, "edits": [[1]]}, {"kind": "progressTask"}]}, 7]}
    path = write_db(tmp_path / "state.vscdb", "CREATE TABLE ItemTable (key TEXT, value TEXT)", ("INSERT INTO ItemTable VALUES ('interactive.sessions', ?)", (json.dumps([session, {"sessionId": "w"}, 5]),)))
    got = kinds(NZ.vscode(stores.vscode(spark, [path])))
    assert [g[1:] for g in got[:4]] == [("user_turn", "use X", None, None, None), ("assistant_turn", "ok\n\nthen", None, None, None), ("tool_call", None, "t", None, None), ("file_edit", None, None, None, "/a.py")]
    assert [g[1] for g in got[4:]] == ["unknown", "unknown"]


def test_zed_store(spark, tmp_path):
    thread = {"version": "1", "model": {"provider": "p", "model": "m"}, "messages": [{"User": {"id": "u1", "content": [{"Text": "use X"}, {"Mention": {}}]}}, {"Agent": {"content": [{"Thinking": {"text": "hm"}}, {"Text": "ok"}, {"ToolUse": {"id": "t", "name": "edit_file", "input": {"path": "a", "edits": [{"old_text": "1", "new_text": "2"}, {"new_text": "3"}]}}}], "tool_results": {"t": {"tool_use_id": "t", "is_error": True, "output": "no"}}}}, 5, {"role": "system"}]}
    packed = zstandard.ZstdCompressor().compress(json.dumps(thread).encode())
    path = write_db(tmp_path / "threads.db", "CREATE TABLE threads (id TEXT, summary TEXT, updated_at TEXT, data_type TEXT, data BLOB)", ("INSERT INTO threads VALUES ('z', 's', '2024-01-01T00:00:00Z', 'zstd', ?)", (packed,)), ("INSERT INTO threads VALUES ('y', '', '2025-01-01T00:00:00Z', 'json', ?)", (b"broken",)))
    newer = write_db(tmp_path / "newer.db", "CREATE TABLE threads (id TEXT, summary TEXT, updated_at TEXT, data_type TEXT, data BLOB, created_at TEXT)", ("INSERT INTO threads VALUES ('n', 's', '2024-01-01T00:00:00Z', 'json', ?, '2023-01-01T00:00:00Z')", (json.dumps(thread).encode(),)))
    got = kinds(NZ.zed(stores.zed(spark, [path])))
    assert [(g[1], g[2], g[3], g[4], g[5]) for g in got] == [("session_start", None, None, None, None), ("user_turn", "use X", None, None, None), ("assistant_turn", "ok", None, None, None), ("tool_call", None, "t", None, None), ("tool_result", None, "t", False, None), ("file_edit", None, "t", None, "a"), ("file_edit", None, "t", None, "a"), ("unknown", None, None, None, None), ("session_start", None, None, None, None), ("unknown", None, None, None, None)]
    assert len(kinds(NZ.zed(stores.zed(spark, [newer])))) == 8


def test_agent_stores(spark, tmp_path):
    path = write_db(
        tmp_path / "state.db", "CREATE TABLE sessions (id TEXT, model TEXT, started_at TEXT, title TEXT)", "CREATE TABLE messages (id INTEGER, session_id TEXT, role TEXT, content TEXT, tool_call_id TEXT, tool_calls TEXT, timestamp TEXT)",
        "INSERT INTO sessions VALUES ('h', 'm', '2024-01-01T00:00:00Z', 't')", "INSERT INTO messages VALUES (1, 'h', 'user', 'use X', NULL, NULL, '5')",
        ("INSERT INTO messages VALUES (2, 'h', 'assistant', 'ok', NULL, ?, '6')", (json.dumps([{"id": "t", "function": {"name": "run", "arguments": {"a": 1}}}, {"id": "u", "name": "look"}]),)),
        "INSERT INTO messages VALUES (3, 'h', 'tool', 'out', 't', NULL, '7')", "INSERT INTO messages VALUES (10, 'h', 'system', 'x', NULL, NULL, '8')",
    )
    assert [g[1:5] for g in kinds(NZ.hermes(stores.hermes(spark, [path])))] == [("session_start", None, None, None), ("user_turn", "use X", None, None), ("assistant_turn", "ok", None, None), ("tool_call", None, "t", None), ("tool_result", None, "t", True), ("tool_call", None, "u", None), ("unknown", None, None, None)]
    part = lambda **x: json.dumps(x)
    path = write_db(
        tmp_path / "opencode.db", "CREATE TABLE session (id TEXT, title TEXT, time_created INTEGER)", "CREATE TABLE message (id TEXT, session_id TEXT, data TEXT, time_created INTEGER)", "CREATE TABLE part (id TEXT, message_id TEXT, session_id TEXT, data TEXT)",
        "INSERT INTO session VALUES ('o', 't', 1700000000000)", ("INSERT INTO message VALUES ('m1', 'o', ?, 1700000000001)", (part(role="assistant"),)), ("INSERT INTO message VALUES ('m2', 'o', 'x', 2)",),
        ("INSERT INTO part VALUES ('p2', 'm1', 'o', ?)", (part(type="text", text="b"),)), ("INSERT INTO part VALUES ('p1', 'm1', 'o', ?)", (part(type="text", text="a"),)), ("INSERT INTO part VALUES ('p3', 'm1', 'o', ?)", (part(type="tool", callID="t", tool="run", state={"status": "error", "input": {}, "error": "no"}),)),
        ("INSERT INTO part VALUES ('p4', 'm1', 'o', ?)", (part(type="tool", callID="r", tool="run", state={"status": "running"}),)),
    )
    assert [g[1:5] for g in kinds(NZ.opencode(stores.opencode(spark, [path])))] == [("session_start", None, None, None), ("assistant_turn", "a\nb", None, None), ("tool_call", None, "t", None), ("tool_result", None, "t", False), ("tool_call", None, "r", None)]


def test_files(spark, tmp_path):
    body = "é\n\nlast".encode()
    (tmp_path / "a.jsonl").write_bytes(body)
    (tmp_path / "b.jsonl.zst").write_bytes(zstandard.ZstdCompressor().compress(body + b"\n"))
    (tmp_path / "c.json").write_text('[{"a":1},\n 2]')
    got = [(os.path.basename(r.run_id), r.line_no, r.byte_offset, r.line) for r in read_lines(spark, str(tmp_path)).orderBy("run_id", "line_no").collect()]
    assert got[:3] == [("a.jsonl", 1, 0, "é"), ("a.jsonl", 2, 3, ""), ("a.jsonl", 3, 4, "last")] and [g[1:] for g in got[3:6]] == [g[1:] for g in got[:3]]
    assert [r.line for r in read_documents(spark, str(tmp_path / "c.json")).orderBy("line_no").collect()] == ['{"a":1}', "2"]
    assert [r.line for r in read_documents(spark, str(tmp_path / "a.jsonl")).orderBy("line_no").collect()] == ["é", "", "last"]


def test_discovery(tmp_path):
    make = lambda p: (os.makedirs(os.path.dirname(tmp_path / p), exist_ok=True), (tmp_path / p).write_text("x"))
    for p in (
        ".claude/projects/a/s1.jsonl", ".claude/projects/a/n.txt", ".codex/sessions/2024/rollout-r.jsonl.zst", ".codex/sessions/history.jsonl", ".gemini/tmp/h1/chats/session-g.jsonl", ".gemini/tmp/h1/logs.json", ".gemini/tmp/h2/logs.json",
        ".cursor/projects/p/agent-transcripts/u/subagents/v.jsonl", ".config/Cursor/User/globalStorage/state.vscdb", ".config/Code/User/workspaceStorage/w/state.vscdb", ".local/share/zed/threads/threads.db", ".hermes/state.db", ".local/share/opencode/opencode.db", "other/Codex/A.JSONL",
    ):
        make(p)
    os.symlink(tmp_path / "other", tmp_path / "linked")
    at = P.Places(home=str(tmp_path), env={})
    found = {t: [(os.path.relpath(f.path, tmp_path), f.session_hint, f.compressed) for f in P.discover(t, at)] for t in P.TOOLS}
    assert found["claude_code"] == [(".claude/projects/a/s1.jsonl", "s1", False)] and found["codex"] == [(".codex/sessions/2024/rollout-r.jsonl.zst", "r", True)]
    assert [f[:2] for f in found["gemini"]] == [(".gemini/tmp/h1/chats/session-g.jsonl", "g"), (".gemini/tmp/h2/logs.json", "logs")]
    assert len(found["cursor"]) == 2 and len(found["vscode"]) == len(found["zed"]) == len(found["hermes"]) == len(found["opencode"]) == 1 and not found["otel"]
    assert len(found["copilot"]) == len(found["windsurf"]) == 4
    assert not P.discover("codex", P.Places(home=str(tmp_path), overrides={"CODEX_HOME": str(tmp_path / "none")}, env={}))
    assert [f.path.rsplit("/", 1)[1] for f in P.find_transcripts(tmp_path / "other")] == ["A.JSONL"] and not P.find_transcripts(tmp_path / "absent")
    assert str(P.Places(env={"HOME": "", "HOMEDRIVE": "C:", "HOMEPATH": "/u"}).home_dir()) == "C:/u" and str(P.Places(env={"USERPROFILE": "/p"}).home_dir()) == "/p" and str(P.Places(env={}).home_dir()) == "."
    assert [f.tool for f in P.targets(["codex"], [str(tmp_path / "other")], at)] == ["codex"] and len(P.targets(list(P.TOOLS), [], at)) > 10
    assert P.wanted_tools([]) == list(P.TOOLS) and P.wanted_tools(["Claude", "claude-code", " codex "]) == ["claude_code", "codex"]
    with pytest.raises(ValueError, match="unknown tool"):
        P.wanted_tools(["nothing"])


def transcript(tool, n=5):
    """Lines of one file: every shape of a tool."""
    out = []
    for i, shape in enumerate(("start", "user", "calls", "result", "other", "user", "calls")[:n]):
        out.append(FORMATS[tool][shape][0].replace("[u]", "7").replace("[n]", str(i)).replace("[T]", str(1_700_000_000 + i)))
    return out


def light(events, table=None, secrets=(), content=True, extra=()):
    """A node for each event: what commands and sinks do with nodes doesn't depend on how they are made."""
    props = F.array(F.struct(F.lit("node").alias("key"), F.lit("x").alias("s"), F.lit(None).cast("bigint").alias("i"), F.lit(None).cast("boolean").alias("b")))
    edit = F.col("kind") == "file_edit"
    body = F.to_json(F.struct(F.when(edit, "binding").otherwise("decision").alias("node"), T.redact(F.col("text"), secrets).alias("text") if secrets else F.col("text")))
    return events.select("run_id", "seq", F.lit(1).alias("rank"), F.col("event_id").alias("secondary"), F.when(edit, "binding").otherwise("decision").alias("node"), F.lit("observed").alias("fact_status"), F.col("event_id").alias("pk"), body.alias("json"), props.alias("properties"), F.when(edit, F.col("ts")).alias("valid_at"), F.lit(None).cast("string").alias("episode_id"))


def test_commands(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(N, "prepare", light)
    path = tmp_path / "codex-session.jsonl"
    lines = transcript("codex")
    lines[1] = lines[1].replace("say", "password = hunter2hunter2")
    path.write_text("\n".join(lines) + "\n")
    cli.parse(spark, str(path))
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert len(rows) == 9 and "hunter2" not in json.dumps(rows)
    with pytest.raises(ValueError, match="tells no tool"):
        cli.tool_of("/x/y", None)
    assert cli.tool_of("/x/y", "claude-code") == "claude_code"
    target = cli.capture(spark, str(path), str(tmp_path / "samples"))
    assert target.read_text() == path.read_text() and target.parent.name == "captured" and target.parent.parent.name == "codex"


def test_sinks(spark, tmp_path):
    raw = spark.createDataFrame([("f", i + 1, 0, x) for i, x in enumerate(transcript("codex"))], RAW)
    nodes = light(NZ.codex(raw)).cache()
    n = nodes.count()
    for _ in range(2):
        sinks.build("sqlite", str(tmp_path / "n.db"))(nodes)
        sinks.build("parquet", str(tmp_path / "n.parquet"))(nodes)
    sinks.build("ndjson", str(tmp_path / "n.ndjson"))(nodes)
    assert sum(sinks.count_by_type(str(tmp_path / "n.db")).values()) == n == spark.read.parquet(str(tmp_path / "n.parquet")).count() == spark.read.text(str(tmp_path / "n.ndjson")).count()
    sinks.build("records", str(tmp_path / "r"))(nodes)
    r = spark.read.parquet(str(tmp_path / "r")).collect()
    assert len(r) == n and all((x.kind == 4) == (x.valid_at is not None) for x in r)
    out = io.StringIO()
    sinks.stream(out)(nodes)
    assert len(out.getvalue().splitlines()) == n
    for bad in (("nothing", "x"), ("sqlite", None)):
        with pytest.raises(ValueError):
            sinks.build(*bad)


def test_history(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=Dev", "-c", "user.email=d@x", *a], check=True, capture_output=True)
    git("init", "-q")
    for i, message in enumerate(("feat: use DuckDB instead of pandas\n\nbody line", "chore: nothing", "drop the old loader and add a cache layer")):
        (tmp_path / f"f{i}.py").write_text("x")
        git("add", "-A")
        git("commit", "-q", "-m", message)
    commits, files = G.read_history(spark, str(tmp_path))
    assert commits.count() == 3 and files.count() == 3 and commits.where("author = 'Dev <d@x>'").count() == 3
    s = M.summary(commits, M.commit_nodes(commits, files)).first()
    assert (s.commits, s.decisions, s.links) == (3, 3, 2)
    assert G.read_history(spark, str(tmp_path), most=1)[0].count() == 1
    with pytest.raises(RuntimeError, match="git"):
        G.read_history(spark, str(tmp_path / "none"))


def test_vscode_files_of_both_forms(spark):
    lines = ('{"id":"a","role":"user","text":"one"}', '{"id":"b","requests":[{"message":{"text":"two"},"response":"three"}]}', '{"id":"b","role":"user","text":"seen"}', '{"id":"c","sessionId":"s","role":"user","text":"four"}')
    raw = spark.createDataFrame([("f", i + 1, 0, x) for i, x in enumerate(lines)], RAW)
    got = NZ.normalize(raw, "vscode").orderBy("seq").collect()
    assert [(r.seq, r.text) for r in got] == [(0, "one"), (1, "two"), (2, "three"), (3, "four")] and [r.session_id for r in got] == ["unknown"] + ["vscode-b"] * 3


def _long_numbers(folder):
    """Orders whose numbers have up to 12 digits, and their lines; a connection with both."""
    con = duckdb.connect()
    con.execute("CREATE TABLE orders AS SELECT i + k AS o_orderkey, i % 7 AS o_custkey FROM range(24) r(i), (VALUES (0), (99990), (1000000), (100000000000)) v(k)")
    con.execute("CREATE TABLE lineitem AS SELECT o_orderkey AS l_orderkey, i::INT AS l_linenumber FROM orders, range(1, 5) r(i)")
    for name in ("orders", "lineitem"):
        con.execute(f"COPY {name} TO '{folder}/{name}.parquet'")
    return con


def test_commit_decisions_with_long_numbers(spark, tmp_path):
    """A number alone decides nothing, however long it is."""
    con = _long_numbers(tmp_path)
    got = formats.commit_decisions(spark, str(tmp_path))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, con.execute(formats.ORACLES["commit_decisions"]).fetchall()))
    rows = [(str(i), 0, "", s, "") for i, s in enumerate(("refactor!: 123456", "feat!: 12345a", "revert: 1.2.34", "feat!: 12345"))]
    assert [r.epitome for r in M.classified(spark.createDataFrame(rows, G.COMMITS)).orderBy("sha").collect()] == ["12345a", "1.2.34"]


def test_commit_links_with_long_numbers(spark, tmp_path):
    """Files of commits that decide nothing are linked to nothing."""
    con = _long_numbers(tmp_path)
    got = formats.commit_links(spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, con.execute(formats.ORACLES["commit_links"]).fetchall())) and len(got) > 100


def test_commits_with_odd_keys_and_files_equal_their_sql(spark, tmp_path):
    """Files without a line number, and orders with negative or no keys."""
    con = duckdb.connect()
    con.execute("CREATE TABLE orders AS SELECT i AS o_orderkey, i % 7 AS o_custkey FROM range(-30, 60) r(i) UNION ALL SELECT NULL, 1")
    con.execute("CREATE TABLE lineitem AS SELECT o_orderkey AS l_orderkey, CASE WHEN i < 5 THEN i END::INT AS l_linenumber FROM orders, range(1, 7) r(i) WHERE o_orderkey % 5 < i OR o_orderkey IS NULL")
    for name in ("orders", "lineitem"):
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet'")
    for name in ("commit_decisions", "commit_links"):
        want = con.execute(formats.ORACLES[name]).fetchall()
        got = [tuple(r) for r in formats.QUERIES[name](spark, str(tmp_path)).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want)) and want


def test_hook(tmp_path):
    got = hook.record_hook(b'{"hook_event_name":"Stop","transcript_path":"/t.jsonl","x":1}')
    assert got.rest == {"x": 1} and got.record[0] == "/t.jsonl" and hook.record_hook(b"{}").record[0] == "<hook stdin>"
    assert hook.record_hook(b"no") is None and hook.record_hook(b'{"cwd":3}') is None and hook.record_hook(b"[]") is None
    assert hook.land(b'{\n"a": 1}', str(tmp_path)) and not hook.land(b"no", str(tmp_path))
    assert (tmp_path / "hook.jsonl").read_text() == '{"a":1}\n'


def test_receiver(tmp_path):
    r = otlp.Receiver(otlp.landing(str(tmp_path))).start()

    def send(method, body=b"", headers=None):
        c = http.client.HTTPConnection(*r.address, timeout=5)
        c.request(method, "/v1/logs", body, headers or {})
        a = c.getresponse()
        return a.status, a.read().decode()

    assert send("POST", b'[{"a":1},{"b":2}]') == (200, '{"accepted":2}') and send("POST", b'{"c":\n3}') == (200, '{"accepted":1}') and send("POST", b'{"d":4}\n\n{"e":5}\n') == (200, '{"accepted":2}')
    assert send("POST", b'{"a":1}\nbroken')[0] == 400 and send("POST", b"\xff")[0] == 400 and send("GET")[0] == 405 and send("POST", b"")[1] == '{"accepted":0}'
    c = http.client.HTTPConnection(*r.address, timeout=5)
    c.putrequest("POST", "/")
    c.putheader("Content-Length", str(otlp.MAX_BODY + 1))
    c.endheaders()
    assert c.getresponse().status == 413
    r.stop()
    assert (tmp_path / "otlp.jsonl").read_text().splitlines() == ['{"a":1}', '{"b":2}', '{"c":3}', '{"d":4}', '{"e":5}']
    with pytest.raises(ValueError, match="loopback"):
        otlp.Receiver(print, "192.0.2.1")


def test_settings():
    c = config.parse('[capture]\ntools=["codex"]\nhome="/h"\n[tools.codex.overrides]\nCODEX_HOME="/c"\n[[gate.rules]]\nid="a"\ncategory="ban"\npattern="x+"\n[redact]\nno_content=true\n[[redact.patterns]]\nlabel="l"\npattern="p"\n[sink]\ntarget="sqlite"\n[sink.sqlite]\npath="/n.db"\n[ingest]\nbackfill_days=3\n')
    assert (c.tools, str(c.places.home_dir()), c.places.setting("CODEX_HOME"), c.rules, c.content, c.secrets, c.sink, c.out, c.backfill_days) == (["codex"], "/h", "/c", (("a", "ban", "strong", "x+"),), False, (("l", "p"),), "sqlite", "/n.db", 3)
    assert config.parse("").sink == "ndjson" and len(config.parse("").rules) == 28
    for bad in ("[capture]\nodd=1", "odd=1", '[[gate.rules]]\nid="a"\ncategory="none"\npattern="x"', "[sink.sqlite]\nx=1"):
        with pytest.raises(ValueError):
            config.parse(bad)


def test_tail_offsets(tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text("one\ntwo\nthr")
    r = TL._TailReader({"root": str(tmp_path)})
    first = r.latestOffset()
    assert [(x[1], x[2], x[3]) for p in r.partitions(r.initialOffset(), first) for x in r.read(p)] == [(1, 0, "one"), (2, 4, "two")]
    path.write_text("one\ntwo\nthree\n")
    (tmp_path / "b.jsonl").write_text("new\n")
    second = r.latestOffset()
    assert [x[1:] for p in r.partitions(first, second) for x in r.read(p)] == [(3, 8, "three"), (1, 0, "new")]
    # Another reader takes up from the checkpoint.
    again = TL._TailReader({"root": str(tmp_path)})
    assert again.partitions(second, second) == [] and again.latestOffset() == second
    path.write_text("x\n")
    third = r.latestOffset()
    assert [x[1:] for p in r.partitions(second, third) for x in r.read(p)] == [(1, 0, "x")]
    os.remove(path)
    assert r.latestOffset() == third


def test_live_nodes_change_with_later_records(spark, tmp_path):
    logs, seen = tmp_path / "logs", {}
    logs.mkdir()
    path = logs / "codex-a.jsonl"
    lines = transcript("codex", 7)
    lines[3] = lines[3].replace("c3", "c2")  # the result of the call before it

    def write(nodes):
        seen.clear()
        seen.update({r.pk: r.node for r in nodes.collect()})

    def episodes(events):
        return O.episodes(events).select(F.col("episode_id").alias("pk"), F.lit("episode").alias("node"))

    def drain():
        TL.live(spark, str(logs), str(tmp_path / "store"), str(tmp_path / "check"), write, prepare=episodes, once=True).awaitTermination()
        return sorted(seen.values())

    path.write_text("\n".join(lines[:3]) + "\n" + lines[3][:20])
    assert drain() == ["episode", "episode"]
    # The patch failed: the edits of its call are none.
    path.write_text("\n".join(lines[:4]) + "\n")
    assert drain() == []
    seen["kept"] = "x"
    assert drain() == ["x"]  # nothing new, so nothing is written
