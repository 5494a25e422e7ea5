"""Transcripts of every tool made from the events table, their events, and what DuckDB makes of the same rows without JSON.

A user is a file and a session; each event is a record whose shape its number decides,
and every eleventh repeats the one before. Templates hold [u] the user, [n] the record
that is written, [l] its line and [T] its time; # is the hash of the line.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import commits as M
from ..operators import normalize as N
from ..operators import transcript as O

#: Shapes by number: the first record of a file, then these in turn.
TURN = ("user", "user", "calls", "result", "other")


def _export(call: str, result: str, edit: str, parts: dict[str, str] | None = None, other_once: bool = False) -> dict:
    return {
        "start": ('{"kind":"session_start","sessionId":"s[u]","id":"e[n]","cwd":"/w/[u]","git":{"sha":"abc"},"ts":[T]}', [("session_start", "e[n]", None, None, None, None, None, True)]),
        "user": ('{"id":"e[n]","role":"user","text":"say [n]","sessionId":"s[u]","ts":[T]}', [("user_turn", "e[n]", "say [n]", None, None, None, None, True)]),
        "calls": (
            '{"id":"e[n]","parentId":"e0","role":"assistant","text":"do [n]","model":"m","ts":[T],"usage":{"input":3},"toolCalls":[{"id":"c[n]","name":"edit","args":{"b":1,"a":2}},{"id":"d[n]","name":"look"}]}',
            [("assistant_turn", "e[n]", "do [n]", None, None, None, None, True), ("tool_call", f"e[n]{call.format(0)}c[n]", None, "c[n]", None, None, None, True), ("tool_call", f"e[n]{call.format(1)}d[n]", None, "d[n]", None, None, None, True)],
        ),
        "result": (
            '{"id":"e[n]","role":"assistant","text":"done","ts":[T],"toolResults":[{"id":"c[n]","ok":false,"output":"no"}],"edits":[{"path":"src/f[n].rs","callId":"c[n]","id":"c[n]","added":2,"removed":-1,"newText":"x"}]}',
            [("assistant_turn", "e[n]", "done", None, None, None, None, True), ("tool_result", f"e[n]{result.format(0)}c[n]", None, "c[n]", False, None, None, True), ("file_edit", f"e[n]{edit}", None, "c[n]", None, "src/f[n].rs", 2, True)],
        ),
        "other": ('{"kind":"odd","ts":[T]}', [("unknown", "#", None, None, None, None, None, other_once)]),
    }


def _store() -> dict:
    return {
        "start": ('{"kind":"session_start","sessionId":"s[u]","ts":[T]}', [("session_start", "s[u]:start", None, None, None, None, None, True)]),
        "user": ('{"id":"s[u]:[n]","sessionId":"s[u]","role":"user","text":"say [n]","ts":[T]}', [("user_turn", "s[u]:[n]", "say [n]", None, None, None, None, True)]),
        "calls": (
            '{"id":"s[u]:[n]","role":"assistant","text":"do [n]","ts":[T],"toolCalls":[{"id":"c[n]","name":"run","args":{}},7,{"id":"d[n]","name":"look"}],"toolResults":[{"id":"d[n]","ok":false,"output":"no"}]}',
            [("assistant_turn", "s[u]:[n]", "do [n]", None, None, None, None, True), ("tool_call", "c[n]:call", None, "c[n]", None, None, None, True), ("tool_call", "d[n]:call", None, "d[n]", None, None, None, True), ("tool_result", "d[n]:result", None, "d[n]", False, None, None, True)],
        ),
        "result": ('{"id":"s[u]:[n]","role":"assistant","text":"done","ts":[T]}', [("assistant_turn", "s[u]:[n]", "done", None, None, None, None, True)]),
        "other": ('{"x":[n],"ts":[T]}', [("unknown", "#", None, None, None, None, None, False)]),
    }


#: For each shape the line, and its events: kind, id, text, call_id, ok, path, added, and whether a repeat of the record drops it.
FORMATS: dict[str, dict[str, tuple[str, list[tuple]]]] = {
    "claude_code": {
        "start": (
            '{"type":"user","uuid":"e[n]","sessionId":"s[u]","cwd":"/w/[u]","gitBranch":"main","version":"2.0.1","timestamp":[T],"message":{"role":"user","content":"open [n]"}}',
            [("session_start", "e[n]#start", None, None, None, None, None, True), ("user_turn", "e[n]", "open [n]", None, None, None, None, True)],
        ),
        "user": ('{"type":"user","uuid":"e[n]","timestamp":[T],"message":{"content":[{"type":"text","text":"say"},{"type":"image"},{"type":"text","text":"[n]"}]}}', [("user_turn", "e[n]", "say\n[n]", None, None, None, None, True)]),
        "calls": (
            '{"type":"assistant","uuid":"e[n]","parentUuid":"e0","timestamp":[T],"message":{"model":"m","usage":{"input_tokens":3},"content":[{"type":"thinking","thinking":"hm"},{"type":"text","text":"do [n]"},{"type":"tool_use","id":"c[n]","name":"Edit","input":{"b":1,"a":2}}]}}',
            [("assistant_turn", "e[n]", "do [n]", None, None, None, None, True), ("tool_call", "e[n]#call:0", None, "c[n]", None, None, None, True)],
        ),
        "result": (
            '{"type":"user","uuid":"e[n]","timestamp":[T],"message":{"content":[{"type":"tool_result","tool_use_id":"c[n]","is_error":true,"content":"no"}]},"toolUseResult":{"filePath":"src/f[n].rs","structuredPatch":[{"lines":["+a","-b"," c"]},{"lines":["+d"]}]}}',
            [("user_turn", "e[n]", "", None, None, None, None, True), ("tool_result", "e[n]#result:0", None, "c[n]", False, None, None, True), ("file_edit", "e[n]#edit", None, "c[n]", None, "src/f[n].rs", 2, True)],
        ),
        "other": ('{"type":"summary","uuid":"e[n]","timestamp":[T]}', [("unknown", "#", None, None, None, None, None, True)]),
    },
    "codex": {
        "start": ('{"timestamp":[T],"type":"session_meta","payload":{"id":"s[u]","cwd":"/w/[u]","cli_version":"1","git":{"sha":"abc","branch":"main"}}}', [("session_start", "session_meta:s[u]", None, None, None, None, None, True)]),
        "user": ('{"timestamp":[T],"type":"response_item","payload":{"type":"message","role":"user","id":"e[n]","content":[{"type":"input_text","text":"say"},{"type":"input_text","text":"[n]"}]}}', [("user_turn", "e[n]", "say\n[n]", None, None, None, None, True)]),
        "calls": (
            r'{"timestamp":[T],"type":"response_item","payload":{"type":"function_call","name":"apply_patch","call_id":"c[n]","arguments":"{\"input\":\"*** Begin Patch\\n*** Update File: src/f[n].rs\\n@@\\n+a\\n-b\\n+c\\n*** Add File: g\\n+x\\n*** End Patch\"}"}}',
            [("tool_call", "c[n]", None, "c[n]", None, None, None, True), ("file_edit", "c[n]#edit:src/f[n].rs", None, "c[n]", None, "src/f[n].rs", 2, True), ("file_edit", "c[n]#edit:g", None, "c[n]", None, "g", 1, True)],
        ),
        "result": (
            r'{"timestamp":[T],"type":"event_msg","payload":{"type":"patch_apply_end","call_id":"c[n]","success":false,"stderr":"no","changes":{"b.rs":{"unified_diff":"--- a\n+++ b\n+x\n+y"},"a.rs":{"unified_diff":"-y"}}}}',
            [("tool_result", "c[n]:patch_apply_end", None, "c[n]", False, None, None, True), ("file_edit", "patch:c[n]:a.rs:[l]", None, "c[n]", None, "a.rs", 0, False), ("file_edit", "patch:c[n]:b.rs:[l]", None, "c[n]", None, "b.rs", 2, False)],
        ),
        "other": ('{"timestamp":[T],"type":"turn_context","payload":{}}', [("unknown", "#", None, None, None, None, None, False)]),
    },
    "gemini": {
        "start": ('{"$set":{"sessionId":"s[u]","cwd":"/w/[u]","commit":"abc"},"id":"e[n]","timestamp":[T]}', [("session_start", "e[n]", None, None, None, None, None, True)]),
        "user": ('{"type":"user","id":"e[n]","timestamp":[T],"content":[{"text":"say "},"[n]",{"thought":"x"}]}', [("user_turn", "e[n]", "say [n]", None, None, None, None, True)]),
        "calls": (
            '{"type":"gemini","id":"e[n]","timestamp":[T],"text":"do [n]","tokens":{"input":3},"toolCalls":[{"callId":"c[n]","name":"write","args":{},"resultDisplay":{"fileName":"src/f[n].rs","newContent":"x","diffStat":{"added":2}}},{"name":"look","status":"error","result":"no"}]}',
            [
                ("assistant_turn", "e[n]", "do [n]", None, None, None, None, True), ("tool_call", "c[n]:call", None, "c[n]", None, None, None, True), ("tool_result", "c[n]:result", None, "c[n]", True, None, None, True), ("file_edit", "c[n]:edit", None, "c[n]", None, "src/f[n].rs", 2, True),
                ("tool_call", "e[n]:tool:1:call", None, "e[n]:tool:1", None, None, None, True), ("tool_result", "e[n]:tool:1:result", None, "e[n]:tool:1", False, None, None, True),
            ],
        ),
        "result": ('{"$rewindTo":"e0","id":"e[n]","timestamp":[T]}', [("rewind", "e[n]", None, None, None, None, None, True)]),
        "other": ('{"type":"info","id":"e[n]","timestamp":[T]}', [("unknown", "#", None, None, None, None, None, False)]),
    },
    "otel": {
        "start": ('{"time":[T],"gen_ai.operation.name":"session.start","gen_ai.conversation.id":"s[u]","cwd":"/w/[u]","git.commit":"abc"}', [("session_start", "#:session_start:0", None, None, None, None, None, True)]),
        "user": ('{"time":[T],"attributes":[{"key":"gen_ai.cli.user_prompt","value":{"stringValue":"say [n]"}},{"key":"n","value":{"intValue":"3"}}]}', [("user_turn", "#:user_prompt:0", "say [n]", None, None, None, None, True)]),
        "calls": (
            '{"time":[T],"gen_ai.operation.name":"execute_tool","gen_ai.tool.name":"edit","gen_ai.tool.call.id":"c[n]","status":"ERROR","file.path":"src/f[n].rs","code.added_lines":"2"}',
            [("tool_call", "#:tool_call:0", None, "c[n]", None, None, None, True), ("tool_result", "#:tool_result:0", None, "c[n]", False, None, None, True), ("file_edit", "#:file_edit:0", None, "c[n]", None, "src/f[n].rs", 2, True)],
        ),
        "result": ('{"time":[T],"gen_ai.input.messages":[{"role":"system","content":"x"},{"role":"User","content":"in [n]"}],"gen_ai.output.messages":[{"parts":[{"text":"say"},{"content":"[n]"}]}]}', [("user_turn", "#:input_msg:1", "in [n]", None, None, None, None, True), ("assistant_turn", "#:output_msg:0", "say\n[n]", None, None, None, None, True)]),
        "other": ('{"time":[T],"x":[n]}', [("unknown", "#", None, None, None, None, None, True)]),
    },
    "cursor": _export("#toolcall:", "#toolresult:", "#edit:0"),
    "windsurf": _export("#toolcall:", "#toolresult:", "#edit:0"),
    "zed": _export(":call:", ":result:", "#edit:0"),
    "vscode": _export(":toolcall:{}:", ":toolresult:{}:", ":edit:0:c[n]", other_once=True),
    "copilot": _export(":call:", ":result:", ":edit:0:src/f[n].rs"),
    "hermes": _store(),
    "opencode": _store(),
}
COLUMNS = ("text", "call_id", "ok", "path", "added")


def _pieces(template: str) -> list[str]:
    return [p for p in re.split(r"(\[[unlT]\]|#(?=:|$))", template) if p]


def _column(template: str) -> Column:
    named = {"[u]": F.col("user_id"), "[n]": F.col("r"), "[l]": F.col("n") + 1, "[T]": F.col("r") + 1_700_000_000}
    return F.concat(*[named[p].cast("string") if p in named else F.lit(p) for p in _pieces(template) or [""]])


def lines(spark: SparkSession, sf_dir: str, tool: str) -> DataFrame:
    """The raw records of one tool's files."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts")
    e = e.withColumn("n", (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("bigint")).withColumn("r", F.when(F.col("n") % 11 == 10, F.col("n") - 1).otherwise(F.col("n")))
    shapes = FORMATS[tool]
    line = F.when(F.col("r") == 0, _column(shapes["start"][0]))
    for i, shape in enumerate(TURN):
        line = line.when(F.col("r") % len(TURN) == i, _column(shapes[shape][0]))
    return e.select(F.concat(F.lit("f"), "user_id").alias("run_id"), (F.col("n") + 1).alias("line_no"), F.lit(0).cast("bigint").alias("byte_offset"), line.alias("line"))


def _query(tool: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = N.normalize(lines(spark, sf_dir, tool), tool)
        return events.select("run_id", "session_id", "seq", "kind", "event_id", F.unix_seconds("ts").alias("at"), F.col("project.cwd").alias("cwd"), *COLUMNS)

    run.__name__ = f"events_{tool}"
    return run


def _sql(template: str | None, as_line: bool = False) -> str:
    if template is None:
        return "NULL"
    named = {"[u]": "user_id", "[n]": "r", "[l]": "(n + 1)", "[T]": "(r + 1700000000)", "#": "sha256(line)"}
    return "(" + " || ".join(named[p] if p in named and not (as_line and p == "#") else "'" + p.replace("'", "''") + "'" for p in _pieces(template) or [""]) + ")"


def _oracle(tool: str) -> str:
    shapes = FORMATS[tool]
    pick = lambda of: "CASE WHEN r = 0 THEN " + of("start") + " " + " ".join(f"WHEN r % {len(TURN)} = {i} THEN {of(s)}" for i, s in enumerate(TURN)) + " END"

    def events(shape: str) -> str:
        rows = []
        for ord_, (kind, eid, text, call, ok, path, added, once) in enumerate(shapes[shape][1]):
            rows.append(f"{{'ord': {ord_}, 'kind': '{kind}', 'event_id': {_sql(eid)}, 'text': {_sql(text)}, 'call_id': {_sql(call)}, 'ok': {'NULL' if ok is None else ok}::BOOLEAN, 'path': {_sql(path)}, 'added': {'NULL' if added is None else added}::BIGINT, 'once': {once}}}")
        return "[" + ", ".join(rows) + "]"

    cwd = "'.'" if tool in ("hermes", "opencode") else "'/w/' || user_id"
    kept, number = "(n = r OR NOT d.once)", "row_number() OVER (PARTITION BY user_id ORDER BY n, d.ord) - 1 AS seq"
    inner = f"SELECT *, {number} FROM fanned" + ("" if tool == "otel" else f" WHERE {kept}")
    return f"""
WITH numbered AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events),
written AS (SELECT user_id, n, CASE WHEN n % 11 = 10 THEN n - 1 ELSE n END AS r FROM numbered),
lined AS (SELECT *, {pick(lambda s: _sql(shapes[s][0], True))} AS line FROM written),
fanned AS (SELECT user_id, n, r, unnest({pick(events)}) AS d FROM lined),
kept AS ({inner})
SELECT 'f' || user_id AS run_id, 's' || user_id AS session_id, seq, d.kind AS kind, d.event_id AS event_id, r + 1700000000 AS at, {cwd} AS cwd, {', '.join(f'd.{c} AS {c}' for c in COLUMNS)}
FROM kept{f" WHERE {kept}" if tool == "otel" else ""}"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sure each tool is that a line of each tool is its own: sample, shape, tool, variant, confidence, n."""
    out = None
    for tool in FORMATS:
        some = lines(spark, sf_dir, tool).where("line_no <= 6").select(F.lit(tool).alias("sample"), F.lit(None).cast("string").alias("x"), "line_no", "line")
        out = some if out is None else out.unionByName(some)
    prints = F.array(*[N.fingerprint(t, F.col("line")) for t in N.NORMALIZERS])
    each = out.select("sample", "line_no", F.explode(prints).alias("p"))
    return each.groupBy("sample", "line_no", F.col("p.source").alias("tool"), F.col("p.variant").alias("variant"), F.col("p.confidence").alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


#: Subject, body, and what they decide: epitome, options, ban, status of each part. X stands for the commit's number.
COMMITS = (
    ("feat(api): add paging to the list route X", "", (("add paging to the list route X", "", False, "deterministically_derived"),)),
    ("chore: tidy up", "", ()),
    ("use Postgres instead of MySQL, drop the cron job and add a retry loop", "", (("use Postgres instead of MySQL", "+Postgres,-MySQL", False, "observed"), ("drop the cron job", "+the cron job", True, "observed"), ("add a retry loop", "", False, "observed"))),
    ("fix: a typo in X", "see below", ()),
    ("docs: note X", "intro\n- we switched to mdbook because it builds faster\nend", (("we switched to mdbook because it builds faster", "", False, "observed"),)),
    ("refactor!: X", "", ()),
    ("refactor!: move state X", "", (("move state X", "", False, "observed"),)),
    ("Merge branch 'x'", "", ()),
    ("revert: the new scheduler", "This reverts commit abc", (("the new scheduler", "", False, "observed"),)),
    ("feat: update things", "", ()),
    ("perf: cache parsed rules", "", (("cache parsed rules", "", False, "deterministically_derived"),)),
    ("Fixes #12: we will no longer use chrono in X", "", (("Fixes #12: we will no longer use chrono in X", "+chrono in X", True, "observed"),)),
)


def commits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A commit for each order and a file for each of its lines, some twice."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    kind, no = (F.col("o_orderkey") % len(COMMITS)).cast("int"), F.col("o_orderkey").cast("string")
    text = lambda i: F.replace(F.get(F.array(*[F.lit(c[i]) for c in COMMITS]), kind), F.lit("X"), no)
    sha = F.sha1(no.cast("binary"))
    c = o.select(sha.alias("sha"), (F.lit(1_700_000_000) + F.col("o_orderkey") % 1000).cast("bigint").alias("epoch"), F.when(F.col("o_custkey") % 3 > 0, F.concat(F.lit("dev"), F.col("o_custkey") % 3)).otherwise(" ").alias("author"), text(0).alias("subject"), text(1).alias("body"))
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return c, li.select(F.sha1(F.col("l_orderkey").cast("string").cast("binary")).alias("sha"), F.concat(F.lit("src/"), F.col("l_linenumber") % 3, F.lit(".py")).alias("path"))


def commit_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided, _ = M.mined(*commits(spark, sf_dir))
    options = F.array_join(F.transform("options", lambda o: F.concat(F.when(o["chosen"], "+").otherwise("-"), o["text"])), ",")
    return decided.select("seq", "run_id", "epitome", options.alias("options"), "is_ban", "fact_status", "decided_by")


def commit_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file links of each commit: all of them to its last decision."""
    decided, found = M.mined(*commits(spark, sf_dir))
    bound = O.bindings(found, decided)
    return bound.select("run_id", "decision_id", "episode_id", "path", F.unix_seconds("t_gen").alias("t_gen"))


def _literal(x) -> str:
    return str(x) if isinstance(x, bool) else "'" + x.replace("'", "''") + "'"


_PARTS = ", ".join(f"({i}, {k}, " + ", ".join(map(_literal, part)) + ")" for i, c in enumerate(COMMITS) for k, part in enumerate(c[2]))
_COMMIT_SQL = f"""
WITH orders_ AS (SELECT o_orderkey AS key, sha1(o_orderkey::VARCHAR) AS sha, 1700000000 + o_orderkey % 1000 AS epoch, CASE WHEN o_custkey % 3 > 0 THEN 'dev' || (o_custkey % 3) END AS author FROM orders),
numbered AS (SELECT *, (row_number() OVER (ORDER BY epoch, sha) - 1) * 1000 AS base, 'git:' || substr(sha, 1, 12) AS run_id FROM orders_),
parts(kind, k, epitome, options, is_ban, fact_status) AS (VALUES {_PARTS}),
decided AS (
  SELECT n.*, base + k AS seq, k, replace(epitome, 'X', key::VARCHAR) AS epitome, replace(options, 'X', key::VARCHAR) AS options, is_ban, fact_status, author AS decided_by
  FROM numbered n JOIN parts ON key % {len(COMMITS)} = kind
), files AS (
  SELECT sha, path, row_number() OVER (PARTITION BY sha ORDER BY path) - 1 AS i FROM (SELECT DISTINCT sha1(l_orderkey::VARCHAR) AS sha, 'src/' || (l_linenumber % 3) || '.py' AS path FROM lineitem)
), links AS (
  SELECT run_id, 'decision:' || run_id || ':' || max(seq) AS decision_id, 'episode:git:ep:' || sha || ':' || i AS episode_id, path, epoch + 1 AS t_gen
  FROM decided JOIN files USING (sha) GROUP BY run_id, sha, i, path, epoch
)"""


QUERIES = {f"events_{tool}": _query(tool) for tool in FORMATS} | {"schema_fingerprints": samples, "commit_decisions": commit_decisions, "commit_links": commit_links}
ORACLES = {f"events_{tool}": _oracle(tool) for tool in FORMATS} | {"commit_decisions": _COMMIT_SQL + " SELECT seq, run_id, epitome, options, is_ban, fact_status, decided_by FROM decided", "commit_links": _COMMIT_SQL + " SELECT * FROM links"}
