"""Normalizers: the records of each tool's transcripts become events.

Each takes raw (run_id, line_no, byte_offset, line) and gives the events relation of
events.finish(). Records that a tool doesn't know become unknown events that hold them
as they are; blank lines give nothing. All is Column expressions over Variant: wrong
types, missing keys, deep nesting and text that is no JSON give unknown events, not errors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import variant as V
from . import events as E

J = F.col



def _id(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _n(i: Column) -> Column:
    return i.cast("string")


def _parsed(r: DataFrame, rid: Column, ts: Column, sid: Column, drafts: Column, sid_start: Column | bool = False, project: Column | None = None) -> DataFrame:
    """Records as events.finish() takes them."""
    start = F.lit(sid_start) if isinstance(sid_start, bool) else sid_start
    own = E.null() if project is None else project
    return r.select("run_id", "line_no", "byte_offset", rid.cast("string").alias("rid"), ts.alias("ts"), sid.cast("string").alias("sid"), F.coalesce(start, F.lit(False)).alias("sid_start"), own.cast(E.PROJECT).alias("project"), drafts.cast(E.DRAFTS).alias("drafts"))


def _unknowns() -> Column:
    return E.drafts(E.unknown_record())


# ---- conversation logs with content blocks ----


def claude_code(raw: DataFrame) -> DataFrame:
    """Dialogue records with content blocks; the first of a file also opens the session."""
    j, base = J("j"), J("uuid")
    r = E.records(raw).withColumns({
        "uuid": F.when(j.isNotNull(), F.coalesce(V.text(j, "uuid"), E.content_id(J("line")))), "type": V.text(j, "type"), "content": V.get(j, "message", "content"),
        "patch": V.items(j, "toolUseResult", "structuredPatch"), "parent": V.text(j, "parentUuid"),
    })
    r = r.withColumns({"turn": V.one_of(J("type"), ("user", "assistant")), "may_open": V.one_of(J("type"), ("user", "assistant", "system")), "blocks": V.items_or_none(J("content")), "plain": V.text_of(J("content"))})
    opener = F.row_number().over(W.partitionBy("run_id", "may_open").orderBy("line_no"))
    r = r.withColumn("opens", J("may_open") & (opener == 1))
    branch, sha = V.filled(j, "gitBranch"), F.coalesce(V.text(j, "gitSha"), F.lit(""))
    git = F.when(branch.isNotNull() | (sha != ""), F.struct(sha.alias("sha"), branch.alias("branch")))
    cwd = F.coalesce(V.text(j, "cwd"), F.lit("."))
    kind = lambda b: V.text(b, "type")
    of = lambda name: F.filter(J("blocks"), lambda b: F.coalesce(kind(b) == name, F.lit(False)))
    str_or = lambda b, k: F.coalesce(V.text(b, k), F.lit(""))
    said = lambda name: F.coalesce(V.lines_joined(F.transform(of(name), lambda b: V.text(b, name))), F.lit(""))
    text = F.coalesce(J("plain"), said("text"))

    def as_part(b: Column) -> Column:
        return (
            F.when(kind(b) == "text", E.part("text", text=str_or(b, "text")))
            .when(kind(b) == "thinking", E.part("thinking", text=str_or(b, "thinking")))
            .when(kind(b) == "tool_use", E.part("tool_use", call_id=str_or(b, "id"), name=str_or(b, "name"), args=V.json(b, "input")))
            .when(kind(b) == "tool_result", E.part("tool_result", call_id=str_or(b, "tool_use_id"), output=V.json(b, "content")))
            .when(kind(b) == "image", E.part("image", media_type=V.text(b, "source", "media_type")))
            .otherwise(E.part("other", raw=V.json(b)))
        )

    parts = F.when(J("plain").isNotNull(), F.array(E.part("text", text=J("plain")))).otherwise(F.transform("blocks", as_part))
    tokens = V.get(j, "message", "usage")
    u = E.usage(*[V.natural(tokens, k) for k in ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")])
    model = F.coalesce(V.text(j, "message", "model"), V.text(j, "model"))
    start = E.draft("session_start", _id(base, "#start"), parent_id=J("parent"), cwd=cwd, git=git, model=F.coalesce(V.text(j, "model"), V.text(j, "message", "model")), tool_version=V.text(j, "version"))
    assistant = J("type") == "assistant"
    turn = E.draft(
        F.when(assistant, "assistant_turn").otherwise("user_turn"), base, parent_id=J("parent"), text=text, parts=parts,
        thinking=F.when(assistant, F.nullif(said("thinking"), F.lit(""))), model=F.when(assistant, model), usage=F.when(assistant & type_there(tokens), u),
    )
    calls = E.each(of("tool_use"), lambda b, i: E.draft("tool_call", _id(base, "#call:", _n(i)), parent_id=base, call_id=str_or(b, "id"), name=str_or(b, "name"), args=V.json(b, "input")))
    results = E.each(of("tool_result"), lambda b, i: E.draft("tool_result", _id(base, "#result:", _n(i)), parent_id=base, call_id=str_or(b, "tool_use_id"), ok=~F.coalesce(V.boolean(b, "is_error"), F.lit(False)), output=V.json(b, "content")))
    lines = F.filter(F.flatten(F.transform("patch", lambda h: F.transform(V.items_or_none(h, "lines"), V.text_of))), lambda x: x.isNotNull())
    count = lambda sign: F.size(F.filter(lines, lambda x: x.startswith(sign)))
    called = F.get(F.filter(F.transform(F.filter("blocks", lambda b: V.one_of(kind(b), ("tool_result", "tool_use"))), lambda b: F.when(kind(b) == "tool_result", V.text(b, "tool_use_id")).otherwise(V.text(b, "id"))), lambda x: x.isNotNull()), F.lit(0))
    edit = E.draft(
        "file_edit", _id(base, "#edit"), parent_id=base, call_id=called, path=F.coalesce(V.text(j, "toolUseResult", "filePath"), F.lit("")), old=V.text(j, "toolUseResult", "oldString"),
        new=V.text(j, "toolUseResult", "newString"), unified=F.when(F.size(lines) > 0, F.array_join(lines, "\n")), added=count("+"), removed=count("-"),
    )
    whole = F.concat(E.drafts(turn), calls, results, E.only(J("patch").isNotNull(), E.drafts(edit)))
    drafts = F.concat(E.only(J("opens"), E.drafts(start)), F.when(J("turn"), whole).otherwise(_unknowns()))
    ts = E.time_of(j, "timestamp", "time", "ts")
    return E.finish(_parsed(r, base, ts, V.text(j, "sessionId"), drafts, project=F.when(J("opens"), E.project(cwd, git))), "claude_code")


def type_there(v: Column) -> Column:
    return V.type_of(v).isNotNull()


# ---- rollouts: {type, payload} ----

# Words that mark the output of a failed call.
FAILURE_WORDS = ("error", "failed", "failure", "traceback", "exception", "not found", "no such file", "patch does not apply", "could not apply")


def text_is_ok(s: Column) -> Column:
    """An exit code among the first three lines decides, else words of failure."""
    head = F.slice(F.split(s, "\r?\n"), 1, 3)
    codes = F.filter(F.transform(head, lambda x: F.regexp_extract(T.trim(x), r"^(?:Exit code|exit code|Exit Code):\s*([+-]?\d+)\s*$", 1).try_cast("bigint")), lambda c: c.isNotNull())
    lower = T.ascii_lower(s)
    return F.when(F.size(codes) > 0, F.get(codes, F.lit(0)) == 0).otherwise(~V.any_of(*[lower.contains(w) for w in FAILURE_WORDS]))


def output_is_ok(v: Column) -> Column:
    """Flags, then exit codes, then the text of an output; what says nothing is fine."""
    code = lambda *path: F.when(V.has(v, *path), V.whole(v, *path))
    code_of = lambda *under: F.when(V.has(v, *under, "exit_code"), code(*under, "exit_code")).otherwise(code(*under, "exitCode"))
    of_object = F.coalesce(V.boolean(v, "success"), V.boolean(v, "ok"), code_of() == 0, code_of("metadata") == 0, text_is_ok(V.text(v, "output")), F.lit(True))
    return F.when(V.type_of(v) == "STRING", text_is_ok(V.text_of(v))).when(V.is_object(v), of_object).when(V.type_of(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).otherwise(F.lit(True))


def changed_lines(unified: Column, headers: bool = True) -> tuple[Column, Column]:
    """Lines that begin with + and with -, but for +++ and --- where headers may stand."""
    lines = F.split(F.coalesce(unified, F.lit("")), "\n")
    if headers:
        lines = F.filter(lines, lambda x: ~x.startswith("+++") & ~x.startswith("---"))
    return F.size(F.filter(lines, lambda x: x.startswith("+"))), F.size(F.filter(lines, lambda x: x.startswith("-")))


def patch_sections(patch: Column) -> Column:
    """(path, body) of each file in a patch of "*** Update/Add/Delete File:" sections, without the envelope."""
    mark = r"(?m)^\*\*\* (?:Update|Add|Delete) File: "
    pieces = F.slice(F.split(F.concat(F.lit("\n"), patch), mark), 2, 1 << 30)

    def section(piece: Column) -> Column:
        lines = F.split(piece, "\r?\n")
        body = F.filter(F.slice(lines, 2, 1 << 30), lambda x: ~x.startswith("*** Begin Patch") & ~x.startswith("*** End Patch"))
        # The line break before the next header, or at the end, is no line of its own.
        body = F.when(F.element_at(lines, -1) == "", F.slice(body, 1, F.greatest(F.lit(0), F.size(body) - 1))).otherwise(body)
        return F.struct(T.trim(F.get(lines, F.lit(0))).alias("path"), F.array_join(body, "\n").alias("body"))

    return F.transform(pieces, section)


def codex(raw: DataFrame) -> DataFrame:
    """Rollouts: session_meta, response_item, event_msg and compacted records."""
    j = J("j")
    r = E.records(raw).where("j IS NOT NULL").withColumns({"type": V.text(j, "type"), "p": V.get(j, "payload"), "hash": E.content_id(J("line"))})
    p = J("p")
    r = r.withColumns({
        "there": type_there(p), "sub": V.text(p, "type"), "call": V.text(p, "call_id"), "role": V.text(p, "role"), "name": F.coalesce(V.text(p, "name"), F.lit("")), "item_id": F.coalesce(V.text(p, "id"), J("hash")),
    })
    what = (
        F.when((J("type") == "session_meta") & J("there"), "meta")
        .when((J("type") == "response_item") & J("there"), F.when(V.one_of(J("sub"), ("message", "reasoning", "function_call", "function_call_output", "custom_tool_call", "custom_tool_call_output")), J("sub")).otherwise("unknown"))
        .when((J("type") == "event_msg") & J("there"), F.when(J("sub") == "context_compacted", "compacted").when(V.one_of(J("sub"), ("patch_apply_end", "mcp_tool_call_end")), J("sub")).otherwise("unknown"))
        .when(J("type") == "compacted", "compacted")
        .otherwise("unknown")
    )
    summary = V.get(p, "summary")
    thoughts = F.coalesce(F.array_join(F.filter(F.transform(V.items(summary), lambda x: F.coalesce(V.text(x, "text"), V.text_of(x))), lambda x: x.isNotNull()), "\n"), V.text_of(summary))
    r = r.withColumns({"what": what, "thoughts": F.nullif(thoughts, F.lit(""))})
    call = F.coalesce(J("call"), F.lit(""))
    git = E.git_ref(V.text(p, "git", "sha"), V.text(p, "git", "branch"))
    cwd = F.coalesce(V.text(p, "cwd"), F.lit("."))
    start = E.draft("session_start", F.coalesce(_id("session_meta:", V.text(p, "id")), J("hash")), cwd=cwd, git=git, model=V.text(p, "model"), tool_version=F.coalesce(V.text(p, "cli_version"), V.text(p, "originator")))
    texts = ("input_text", "output_text", "text")
    blocks = F.filter(V.items_or_none(p, "content"), lambda b: ~V.one_of(V.text(b, "type"), texts) | V.text(b, "text").isNotNull())
    as_part = lambda b: (
        F.when(V.one_of(V.text(b, "type"), texts), E.part("text", text=V.text(b, "text")))
        .when(V.one_of(V.text(b, "type"), ("input_image", "image", "output_image")), E.part("image", media_type=F.when(V.has(b, "media_type"), V.text(b, "media_type")).otherwise(V.text(b, "image_url"))))
        .otherwise(E.part("other", raw=V.json(b)))
    )
    text = F.array_join(F.transform(F.filter(blocks, lambda b: V.one_of(V.text(b, "type"), texts)), lambda b: V.text(b, "text")), "\n")
    assistant = J("role") == "assistant"
    turn = E.draft(F.when(assistant, "assistant_turn").otherwise("user_turn"), J("item_id"), text=text, parts=F.transform(blocks, as_part), model=F.when(assistant, V.text(p, "model")))
    thought = E.draft("assistant_turn", J("item_id"), text=F.lit(""), thinking=J("thoughts"), parts=F.array())
    payload = E.unknown(p, V.json(p))
    call_id = F.coalesce(J("call"), J("item_id"))
    body = F.when((J("what") == "custom_tool_call") & V.has(p, "input"), V.get(p, "input")).otherwise(V.get(p, "arguments"))
    args = F.coalesce(V.decoded(body), F.lit("null"))
    tool_call = E.draft("tool_call", call_id, call_id=call, name=J("name"), args=args)
    inner = F.coalesce(V.parse(V.text_of(body)), body)
    patch = F.coalesce(F.when(V.is_object(inner), F.when(V.has(inner, "input"), V.text(inner, "input")).otherwise(V.text(inner, "patch"))), V.text_of(inner), F.when(V.parse(V.text_of(body)).isNull(), V.text_of(body)))

    def v4a(x: Column, i: Column) -> Column:
        added, removed = changed_lines(x["body"], headers=False)
        key = _id(call_id, "#edit:", x["path"])
        return E.draft("file_edit", key, once=key, parent_id=J("call"), call_id=J("call"), path=x["path"], unified=x["body"], added=added, removed=removed)

    legacy = E.only((J("what") == "function_call") & (J("name") == "apply_patch"), E.each(patch_sections(patch), v4a))
    out = V.get(p, "output")
    mcp = V.get(p, "result")
    mcp_ok = F.when(V.has(mcp, "Ok"), ~F.coalesce(V.boolean(mcp, "Ok", "isError"), F.lit(False))).otherwise(~V.has(mcp, "Err"))
    parent = F.when(call != "", call)
    result_id = lambda kind: F.when(call != "", _id(call, ":", kind)).otherwise(_id(kind, ":", J("hash")))
    result = lambda kind, ok, output: E.draft("tool_result", result_id(kind), once=result_id(kind), parent_id=parent, call_id=call, ok=ok, output=output)
    applied = F.coalesce(V.quoted(V.filled(p, "stdout")), V.quoted(V.filled(p, "stderr")), V.json(p, "success"))

    def change(x: Column, i: Column) -> Column:
        unified = V.text(V.parse(x["value"]), "unified_diff")
        added, removed = changed_lines(unified)
        key = _id("patch:", F.when(call != "", call).otherwise(J("hash")), ":", x["key"], ":", _n(J("line_no")))
        return E.draft("file_edit", key, once=key, parent_id=parent, call_id=parent, path=x["key"], unified=unified, added=added, removed=removed)

    drafts = (
        F.when(J("what") == "meta", E.drafts(start))
        .when(J("what") == "message", F.when(V.one_of(J("role"), ("user", "assistant")), E.drafts(turn)).otherwise(E.drafts(payload)))
        .when(J("what") == "reasoning", F.when(J("thoughts").isNotNull(), E.drafts(thought)).otherwise(E.drafts(payload)))
        .when(V.one_of(J("what"), ("function_call", "custom_tool_call")), F.concat(E.drafts(tool_call), legacy))
        .when(V.one_of(J("what"), ("function_call_output", "custom_tool_call_output")), E.drafts(result("output", output_is_ok(out), V.json(p, "output"))))
        .when(J("what") == "mcp_tool_call_end", E.drafts(result("mcp", mcp_ok, V.json(p, "result"))))
        .when(J("what") == "patch_apply_end", F.concat(E.drafts(result("patch_apply_end", F.coalesce(V.boolean(p, "success"), F.lit(True)), applied)), E.each(V.entries(p, "changes"), change)))
        .when(J("what") == "compacted", E.drafts(E.draft("compaction", _id("compaction:", J("hash")), first=F.lit(0), last=F.lit(0))))
        .otherwise(_unknowns())
    )
    rid = (
        F.when(J("what") == "meta", F.coalesce(_id("session_meta:", V.text(p, "id")), J("hash")))
        .when((J("what") == "message") | ((J("what") == "reasoning") & J("thoughts").isNotNull()), J("item_id"))
        .when(V.one_of(J("what"), ("function_call", "custom_tool_call")), call_id)
        .when(J("what") == "compacted", _id("compaction:", J("hash")))
    )
    meta = J("what") == "meta"
    return E.finish(_parsed(r, rid, E.time_of(j, "timestamp", "time", "ts"), F.when(meta, V.text(p, "id")), drafts, sid_start=meta, project=F.when(meta, E.project(cwd, git))), "codex", "follow")


# ---- chats with control records ----


def gemini(raw: DataFrame) -> DataFrame:
    """Dialogue by type or role, {"$set": ...} and {"$rewindTo": ...}."""
    j = J("j")
    times = ("timestamp", "time", "ts", "createdAt", "created_at")
    r = E.records(raw).withColumns({"set": V.get(j, "$set"), "base": F.coalesce(V.first_filled(j, "id", "messageId", "message_id", "uuid"), E.content_id(J("line"))), "role": V.first_filled(j, "type", "role")})
    s, base = J("set"), J("base")
    r = r.withColumns({
        "what": F.when(V.has(j, "$rewindTo"), "rewind").when(type_there(s), "set").when(V.one_of(J("role"), ("user", "gemini", "model", "assistant")), "turn").otherwise("unknown"),
        "cwd": V.first_filled(s, "cwd", "projectRoot", "project_root", "workspace"), "pieces": F.when(V.has(j, "parts"), V.items(j, "parts")).otherwise(V.items(j, "content")),
    })
    git = E.git_ref(V.first_filled(s, "commit", "sha", "head", "gitCommit"), V.first_filled(s, "branch", "gitBranch"))
    start = E.draft("session_start", base, cwd=J("cwd"), git=git, model=V.first_filled(s, "model", "modelName", "model_name"), tool_version=V.first_filled(s, "version", "cliVersion", "cli_version"))
    target = V.get(j, "$rewindTo")
    rewind = E.draft("rewind", base, to_event=F.coalesce(V.text_of(target), F.to_json(target)))
    said = lambda x: F.coalesce(V.text_of(x), V.text(x, "text"))
    text = F.coalesce(V.text(j, "text"), V.text(j, "content"), F.array_join(F.transform("pieces", lambda x: F.coalesce(said(x), F.lit(""))), ""), F.lit(""))
    as_part = lambda x: F.when(said(x).isNotNull(), E.part("text", text=said(x))).when(V.text(x, "thought").isNotNull(), E.part("thinking", text=V.text(x, "thought"))).otherwise(E.part("other", raw=V.json(x)))
    tokens = V.get(j, "tokens")
    counts = [
        V.first_natural(tokens, "input", "inputTokens", "prompt", "promptTokens"), V.first_natural(tokens, "output", "outputTokens", "completion", "completionTokens"),
        V.first_natural(tokens, "cacheRead", "cached", "cachedContentTokens"), V.first_natural(tokens, "cacheCreation", "cacheWrite"),
    ]
    flat = V.first_natural(j, "tokenCount", "totalTokens")
    used = F.when(V.is_object(tokens) & F.coalesce(*counts).isNotNull(), E.usage(*counts)).when(flat.isNotNull(), E.usage(None, flat, None, None))
    assistant = J("role") != "user"
    turn = E.draft(
        F.when(assistant, "assistant_turn").otherwise("user_turn"), base, text=text, parts=F.coalesce(F.transform("pieces", as_part), F.array().cast(f"array<{E.PART}>")),
        thinking=F.when(assistant, V.first_filled(j, "thoughts", "thinking", "reasoning")), model=F.when(assistant, V.first_filled(j, "model", "modelName", "model_name")), usage=F.when(assistant, used),
    )

    def verdict(v: Column) -> Column:
        """One look at a call or its result; null where it says nothing."""
        status, error = T.ascii_lower(V.text(v, "status")), V.get(v, "error")
        return (
            F.when(V.boolean(v, "success").isNotNull(), V.boolean(v, "success")).when(V.boolean(v, "ok").isNotNull(), V.boolean(v, "ok")).when(V.boolean(v, "error").isNotNull(), ~V.boolean(v, "error"))
            .when(status.isin("error", "failed", "failure", "rejected"), False).when(status.isin("success", "ok", "completed"), True)
            .when(V.filled(v, "error").isNotNull() | (V.is_object(error) & (F.to_json(error) != "{}")), False)
        )

    def of_call(c: Column, i: Column) -> Column:
        call = F.coalesce(V.first_filled(c, "callId", "call_id", "id"), _id(base, ":tool:", _n(i)))
        res = F.when(V.has(c, "resultDisplay"), V.get(c, "resultDisplay")).otherwise(V.get(c, "result"))
        args = F.coalesce(*[F.to_json(V.get(c, k)) for k in ("args", "arguments", "input")], F.lit("null"))
        path = V.first_filled(res, "fileName", "filePath", "file", "path")
        shaped = V.is_object(res) & path.isNotNull() & V.any_of(*[V.has(res, k) for k in ("originalContent", "newContent", "fileDiff", "diff", "diffStat")])
        stat = V.get(res, "diffStat")
        count = lambda inside, outside: E.at_most_u32(F.coalesce(F.when(V.is_object(stat), V.first_natural(stat, *inside)).otherwise(V.first_natural(res, *outside)), F.lit(0)))
        edit = E.draft(
            "file_edit", _id(call, ":edit"), parent_id=base, call_id=call, path=path, old=V.first_filled(res, "originalContent", "oldContent", "old"), new=V.first_filled(res, "newContent", "new"),
            unified=V.first_filled(res, "fileDiff", "diff", "unified"), added=count(("added", "additions", "model_added_lines"), ("model_added_lines", "added")), removed=count(("removed", "deletions", "model_removed_lines"), ("model_removed_lines", "removed")),
        )
        return F.concat(
            E.drafts(E.draft("tool_call", _id(call, ":call"), parent_id=base, call_id=call, name=F.coalesce(V.first_filled(c, "name", "tool", "toolName"), F.lit("")), args=args)),
            E.only(type_there(res), E.drafts(E.draft("tool_result", _id(call, ":result"), parent_id=base, call_id=call, ok=F.coalesce(verdict(c), verdict(res), F.lit(True)), output=F.to_json(res)))),
            E.only(shaped, E.drafts(edit)),
        )

    calls = F.coalesce(F.flatten(F.transform(V.items(j, "toolCalls"), of_call)), E.none())
    drafts = (
        F.when(J("what") == "rewind", E.drafts(rewind))
        .when((J("what") == "set") & J("cwd").isNotNull(), E.drafts(start))
        .when(J("what") == "turn", F.concat(E.drafts(turn), calls))
        .otherwise(_unknowns())
    )
    sid = F.when(J("what") == "set", F.coalesce(V.first_filled(s, "sessionId", "session_id", "id"), V.first_filled(j, "sessionId", "session_id")))
    bound = F.when((J("what") == "set") & J("cwd").isNotNull(), E.project(J("cwd"), git, V.first_filled(s, "repoRoot", "repo_root")))
    return E.finish(_parsed(r, F.when(J("what") != "unknown", base), E.time_of(j, *times), sid, drafts, project=bound), "gemini")


# ---- telemetry records ----


def plain_value(v: Column) -> Column:
    """JSON of a wrapped attribute value: {"stringValue": ..} and its like, arrays and lists of keys two levels deep."""

    def scalar(x: Column) -> Column:
        return F.coalesce(*[F.when(V.has(x, k), V.json(x, k)) for k in ("stringValue", "intValue", "boolValue", "doubleValue")], V.json(x))

    def level(x: Column, below) -> Column:
        array, pairs = V.items(x, "arrayValue", "values"), V.items(x, "kvlistValue", "values")
        as_object = F.concat(F.lit("{"), F.array_join(F.transform(F.filter(pairs, lambda e: V.text(e, "key").isNotNull() & V.has(e, "value")), lambda e: F.concat(V.quoted(V.text(e, "key")), F.lit(":"), below(V.get(e, "value")))), ","), F.lit("}"))
        return F.when(array.isNotNull(), F.concat(F.lit("["), F.array_join(F.transform(array, below), ","), F.lit("]"))).when(pairs.isNotNull(), as_object).otherwise(scalar(x))

    return level(v, lambda x: level(x, lambda y: level(y, scalar)))


def otel(raw: DataFrame) -> DataFrame:
    """Flat records with dotted keys, or nested ones with an attributes array. Repeats go after numbering, which leaves gaps."""
    j = J("j")
    wrapped = F.transform(V.items(j, "attributes"), lambda e: F.struct(V.text(e, "key").alias("key"), F.when(V.has(e, "value"), plain_value(V.get(e, "value"))).alias("value")))
    named = F.filter(wrapped, lambda e: e["key"].isNotNull() & e["value"].isNotNull())
    # The last of equal keys counts.
    last = F.filter(named, lambda e, i: ~F.exists(F.slice(named, i + 2, F.size(named) + 1), lambda later: later["key"] == e["key"]))
    flat = F.when(V.is_array(V.get(j, "attributes")), V.parse(F.concat(F.lit("{"), F.array_join(F.transform(last, lambda e: F.concat(V.quoted(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}")))).otherwise(j)
    r = E.records(raw).withColumns({"a": flat, "hash": E.content_id(J("line"))})
    a = J("a")
    r = r.withColumn("op", V.first_text(a, "gen_ai.operation.name", "operation.name", "name"))
    new = lambda kind, i=None: _id(J("hash"), f":{kind}:", F.lit("0") if i is None else _n(i))

    def make(kind: str, what: str, i: Column | None = None, **fields: Column) -> Column:
        return E.draft(kind, new(what, i), once=new(what, i), **fields)

    number = lambda k: F.coalesce(V.natural(a, k), F.when(T.trim(V.text(a, k)).rlike(r"^\+?\d+$"), T.trim(V.text(a, k)).try_cast("bigint")))
    small = lambda *keys: F.coalesce(*[F.when(number(k) <= E.U32, number(k)) for k in keys], F.lit(0))
    git = E.git_ref(V.text(a, "git.commit"), V.text(a, "git.branch"))
    cwd = F.coalesce(V.text(a, "cwd"), V.text(a, "gen_ai.cli.cwd"), F.lit("."))
    model = V.text(a, "gen_ai.request.model")
    start = make("session_start", "session_start", cwd=cwd, git=git, model=model, tool_version=V.first_text(a, "gen_ai.tool.version", "service.version"))
    end = make("session_end", "session_end", reason=V.text(a, "reason"))
    call = F.coalesce(V.text(a, "gen_ai.tool.call.id"), J("hash"))
    status = T.ascii_lower(T.trim(V.first_text(a, "gen_ai.tool.result.status", "otel.status_code", "status")))
    ok = F.when(status.isNotNull(), ~status.isin("error", "failed", "failure", "ko")).when(V.has(a, "error.type") | V.has(a, "exception.type"), False).when(V.has(a, "gen_ai.tool.result"), True)
    path = V.first_text(a, "file.path", "code.filepath")
    edit = lambda cid: make("file_edit", "file_edit", call_id=cid, path=path, added=small("model_added_lines", "code.added_lines"), removed=small("model_removed_lines", "code.removed_lines"))
    tool = F.concat(
        E.drafts(make("tool_call", "tool_call", call_id=call, name=F.coalesce(V.text(a, "gen_ai.tool.name"), F.lit("tool")), args=V.json(a, "gen_ai.tool.call.arguments"))),
        E.only(ok.isNotNull(), E.drafts(make("tool_result", "tool_result", call_id=call, ok=ok, output=V.json(a, "gen_ai.tool.result")))),
        E.only(path.isNotNull(), E.drafts(edit(call))),
    )
    said = lambda m: F.coalesce(V.text(m, "content"), V.lines_joined(F.transform(F.concat(V.items_or_none(m, "parts"), V.items_or_none(m, "content")), lambda x: F.coalesce(V.text_of(x), F.when(V.has(x, "text"), V.text(x, "text")).otherwise(V.text(x, "content"))))))
    spoken = lambda t: F.array(E.part("text", text=t))
    prompt = V.filled(a, "gen_ai.cli.user_prompt")
    ins = F.transform(V.items(a, "gen_ai.input.messages"), lambda m, i: F.struct(i.alias("i"), F.coalesce(T.ascii_lower(V.text(m, "role")) == "user", F.lit(False)).alias("user"), said(m).alias("t")))
    used = [number(f"gen_ai.usage.{k}") for k in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")]
    usage = F.when(used[0].isNotNull() | used[1].isNotNull(), E.usage(*used))
    talk = F.concat(
        E.only(prompt.isNotNull(), E.drafts(make("user_turn", "user_prompt", text=prompt, parts=spoken(prompt)))),
        E.each(F.filter(ins, lambda m: m["user"]), lambda m, _: make("user_turn", "input_msg", m["i"], text=m["t"], parts=spoken(m["t"]))),
        E.each(F.transform(V.items(a, "gen_ai.output.messages"), said), lambda t, i: make("assistant_turn", "output_msg", i, text=t, parts=spoken(t), model=model, usage=usage)),
    )
    lost = E.drafts(E.unknown_record().withField("once", J("hash")))
    drafts = (
        F.when(J("op").isin("session.start", "session_start", "gen_ai.session.start"), E.drafts(start))
        .when(J("op").isin("session.end", "session_end", "gen_ai.session.end"), E.drafts(end))
        .when(J("op").isin("execute_tool", "gen_ai.execute_tool"), tool)
        .when(J("op").isin("file_operation", "gen_ai.file_operation"), F.when(path.isNotNull(), E.drafts(edit(E.null()))).otherwise(lost))
        .otherwise(F.when(F.size(talk) > 0, talk).otherwise(F.when(j.isNull(), _unknowns()).otherwise(lost)))
    )
    opens = J("op").isin("session.start", "session_start", "gen_ai.session.start")
    ts = E.time_of(j, "time", "timestamp", "timeUnixNano", "observedTimeUnixNano", "ts")
    bound = F.when(opens, E.project(cwd, git, V.text(a, "repo_root")))
    return E.finish(_parsed(r, E.null(), ts, V.text(a, "gen_ai.conversation.id"), drafts, project=bound), "otel", project_first=True, gaps=True)


# ---- flat exports: {kind} headers and {role} messages with calls, results and edits ----


def _export(raw: DataFrame, tool: str, starts=("session_start",), ends=("session_end",), empty: bool = True, session: str = "latch", ids: tuple[str, str, str] = ("#toolcall:", "#toolresult:", "#edit:"),
            thinking: bool = True, parts: bool = False, other: str = "whole", blocks: bool = False, once: bool = True, edit_call=("callId", "call_id"), edit_id=None, need_path: bool = False,
            times=("ts", "timestamp", "time", "created_at"), cache=(None, None), sole_call: bool = False, project_first: bool = False, kinds_only: bool = False, clamp: bool = True, beside: DataFrame | None = None) -> DataFrame:
    """What the flat exports share; the arguments are what sets them apart.

    empty: empty texts are texts. ids: infixes of derived ids. other: what becomes of
    another role ("whole" record unknown, "turn" unknown beside its calls, "children" only
    its calls, if it has some). once: derived events are kept once by id. edit_id: the
    path's part in an edit's id. need_path: edits without a path go. kinds_only: any other
    kind makes a record unknown. beside: parsed records of another form in the same files.
    """
    j = J("j")
    text = V.text if empty else V.filled
    r = E.records(raw).withColumns({"object": V.is_object(j), "kind": V.text(j, "kind"), "role": V.text(j, "role"), "base": F.coalesce(text(j, "id"), E.content_id(J("line"))), "own": text(j, "text")})
    base = J("base")
    if blocks:
        content = V.items(j, "message", "content")
        nested = ~V.has(j, "text") & ~V.has(j, "toolCalls") & content.isNotNull()
        said = V.lines_joined(F.transform(content, lambda b: F.when(V.text(b, "type") == "text", V.text(b, "text"))), "\n\n")
        uses = F.filter(F.transform(content, lambda b, i: F.struct(b.alias("b"), i.alias("i"))), lambda x: F.coalesce(V.text(x["b"], "type") == "tool_use", F.lit(False)))
        r = r.withColumns({"own": F.when(nested, said).otherwise(J("own")), "uses": F.when(nested, uses)})
    starting, ending = V.one_of(J("kind"), starts), V.one_of(J("kind"), ends)
    message = J("role").isNotNull() if other == "turn" else V.one_of(J("role"), ("user", "assistant"))
    if other == "children":
        some = V.any_of(*[F.size(V.items_or_none(j, k)) > 0 for k in ("toolCalls", "toolResults", "edits")])
        message = message | some
    if kinds_only:
        message = message & J("kind").isNull()
    r = r.withColumn("what", F.when(~J("object"), "unknown").when(starting, "start").when(ending, "end").when(message, "message").otherwise("unknown"))
    git = E.git_ref(V.filled(j, "git", "sha") if tool in ("zed", "copilot", "vscode") else V.text(j, "git", "sha"), V.filled(j, "git", "branch") if tool in ("zed", "copilot", "vscode") else V.text(j, "git", "branch"))
    cwd = F.coalesce(text(j, "cwd"), V.text(j, "worktree") if tool == "zed" else E.null().cast("string"), F.lit("."))
    ref = lambda *keys: F.coalesce(*[text(j, k) for k in keys])
    wide = tool in ("cursor", "zed")
    start = E.draft("session_start", base, cwd=cwd, git=git, model=text(j, "model"), tool_version=ref("toolVersion", "tool_version") if wide else ref("toolVersion"))
    end = E.draft("session_end", base, reason=text(j, "reason"), parent_id=ref("parentId", "parent_id") if wide else E.null())
    tokens = V.get(j, "usage")
    side = lambda k: V.first_natural(tokens, k, f"{k}_tokens") if wide else V.natural(tokens, k)
    counts = [side("input"), side("output"), *[E.null() if c is None else V.natural(tokens, c) for c in cache]]
    used = F.when(type_there(tokens) if tool == "windsurf" else counts[0].isNotNull() | counts[1].isNotNull(), E.usage(*counts))
    assistant = J("role") == "assistant"
    own = F.coalesce(J("own"), F.lit(""))
    of_text = lambda kind, x: F.when(F.coalesce(x != "", F.lit(False)), F.array(E.part(kind, text=x))).otherwise(F.array().cast(f"array<{E.PART}>"))
    shown = F.concat(of_text("text", J("own")), of_text("thinking", V.text(j, "thinking"))) if parts else F.array()
    turn_kind = F.when(assistant, "assistant_turn").when(J("role") == "user", "user_turn").otherwise("unknown")
    strange = turn_kind == "unknown"
    turn = E.draft(
        turn_kind, base, parent_id=ref("parentId", "parent_id") if wide else ref("parentId"), text=F.when(~strange, own), parts=F.when(~strange, shown.cast(f"array<{E.PART}>")),
        thinking=F.when(assistant, text(j, "thinking")) if thinking else E.null(), model=F.when(assistant, text(j, "model")), usage=F.when(assistant, used), raw_type=F.when(strange, J("role")), raw=F.when(strange, J("body")),
    )
    # Windsurf and the editor exports read elements of any type; the others skip what is no object.
    objects = lambda k: F.filter(F.transform(V.items_or_none(j, k), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda e: V.is_object(e["x"]) if once else F.lit(True))
    lone = F.when(F.size(V.items_or_none(j, "toolCalls")) == 1, V.text(F.get(V.items(j, "toolCalls"), F.lit(0)), "id"))
    index = lambda e: F.concat(_n(e["i"]), F.lit(":")) if edit_id else F.lit("")

    def make(kind: str, event_id: Column, **fields: Column) -> Column:
        return E.draft(kind, event_id, once=event_id if once else E.null(), parent_id=base, **fields)

    def call(e: Column, _: Column) -> Column:
        cid = F.coalesce(text(e["x"], "id"), _id(base, ":call:", _n(e["i"])))
        return make("tool_call", _id(base, ids[0], index(e) if tool == "vscode" else F.lit(""), cid), call_id=cid, name=F.coalesce(text(e["x"], "name"), F.lit("")), args=V.json(e["x"], "args"))

    def result(e: Column, _: Column) -> Column:
        cid = F.coalesce(text(e["x"], "id"), _id(base, ":result:", _n(e["i"])))
        return make("tool_result", _id(base, ids[1], index(e) if tool == "vscode" else F.lit(""), cid), call_id=cid, ok=F.coalesce(V.boolean(e["x"], "ok"), F.lit(True)), output=V.json(e["x"], "output"))

    def edit(e: Column, _: Column) -> Column:
        x = e["x"]
        path = F.coalesce(text(x, "path"), F.lit(""))
        cid = F.coalesce(*[text(x, k) for k in edit_call], lone if sole_call else E.null().cast("string"))
        lines = lambda k: F.coalesce(E.at_most_u32(V.natural(x, k)) if clamp else F.when(V.natural(x, k) <= E.U32, V.natural(x, k)), F.lit(0))
        own_id = _id(base, ids[2], _n(e["i"]), *([":", edit_id(x, path)] if edit_id else []))
        return make("file_edit", own_id, call_id=cid, path=path, old=text(x, "oldText"), new=text(x, "newText"), unified=text(x, "diff"), added=lines("added"), removed=lines("removed"))

    edits = objects("edits")
    if need_path:
        edits = F.filter(edits, lambda e: text(e["x"], "path").isNotNull())
    nested_calls = E.each(J("uses"), lambda u, _: make("tool_call", _id(base, ids[0], F.coalesce(V.text(u["b"], "id"), _id("block:", _n(u["i"])))), call_id=F.coalesce(V.text(u["b"], "id"), _id("block:", _n(u["i"]))), name=F.coalesce(V.text(u["b"], "name"), F.lit("")), args=V.json(u["b"], "input"))) if blocks else E.none()
    spoken = E.only(~strange, E.drafts(turn)) if other == "children" else E.drafts(turn)
    whole = F.concat(spoken, nested_calls, E.each(objects("toolCalls"), call), E.each(objects("toolResults"), result), E.each(edits, edit))
    drafts = F.when(J("what") == "start", E.drafts(start)).when(J("what") == "end", E.drafts(end)).when(J("what") == "message", whole).otherwise(_unknowns())
    sid = F.when(J("object"), F.coalesce(text(j, "sessionId"), V.text(j, "composerId")) if tool == "cursor" else text(j, "sessionId"))
    if session == "latch":
        sid = F.when(J("what") != "unknown", sid)
    bound = F.when(J("what") == "start", E.project(cwd, git, ref("repoRoot", "repo_root") if wide else None))
    rid = F.when((J("what") != "unknown") | (F.lit(tool == "vscode") & J("j").isNotNull()), base)
    parsed = _parsed(r, rid, E.time_of(j, *times), sid, drafts, sid_start=J("what") == "start", project=bound)
    return E.finish(parsed if beside is None else parsed.unionByName(beside), tool, session, project_first)


def cursor(raw: DataFrame) -> DataFrame:
    return _export(raw, "cursor", ("session_start", "session-start", "sessionStart"), ("session_end", "session-end", "sessionEnd"), session="follow", parts=True, other="turn", blocks=True, times=("ts", "timestamp", "time", "created_at", "createdAt"))


def zed(raw: DataFrame) -> DataFrame:
    return _export(raw, "zed", session="start", ids=(":call:", ":result:", "#edit:"), sole_call=True, times=("ts", "timestamp", "time", "created_at", "updated_at"), kinds_only=True)


def copilot(raw: DataFrame) -> DataFrame:
    return _export(raw, "copilot", empty=False, ids=(":call:", ":result:", ":edit:"), need_path=True, edit_id=lambda x, path: path, cache=("cacheRead", "cacheCreation"), project_first=True, kinds_only=True, clamp=False)


def windsurf(raw: DataFrame) -> DataFrame:
    return _export(raw, "windsurf", ends=(), thinking=False, once=False, edit_call=("id",))


def vscode(raw: DataFrame) -> DataFrame:
    """Flat exports, and whole sessions with requests."""
    native = V.items(V.parse(T.trim(F.col("line"))), "requests").isNotNull()
    j = J("j")
    r = E.records(raw.where(native)).withColumn("base", F.coalesce(V.filled(j, "id"), E.content_id(J("line"))))
    spoken = lambda parts: F.array_join(F.filter(F.transform(parts, lambda x: F.when(V.text(x, "kind") == "text", V.filled(x, "text"))), lambda t: t.isNotNull()), "")
    flattened = lambda m: F.coalesce(V.filled(m, "text"), spoken(V.items(m, "parts")), F.lit(""))
    answered = lambda m: F.coalesce(V.text_of(m), F.when(V.is_array(m), spoken(V.items(m))), F.when(V.is_object(m), flattened(m)), F.lit(""))

    def request(q: Column, i: Column) -> Column:
        me = _id(J("base"), ":req:", _n(i))
        return F.array(
            E.draft("user_turn", _id(me, ":user"), text=flattened(V.get(q, "message")), parts=F.array()),
            E.draft("assistant_turn", _id(me, ":asst"), parent_id=_id(me, ":user"), text=answered(V.get(q, "response")), model=V.filled(j, "responderUsername"), parts=F.array()),
        ).cast(E.DRAFTS)

    drafts = F.coalesce(F.flatten(F.transform(V.items(j, "requests"), request)), E.none())
    sid = F.coalesce(V.filled(j, "sessionId"), _id("vscode-", F.substring("base", 1, 16)))
    # A file may hold both forms: its events have one numbering, one session and one set of ids seen.
    return _export(
        raw.where(~native | F.col("line").isNull()), "vscode", empty=False, ids=(":toolcall:", ":toolresult:", ":edit:"), thinking=False, other="children", once=False, times=("ts", "timestamp", "time"),
        edit_id=lambda x, path: F.coalesce(V.filled(x, "id"), path), beside=_parsed(r, J("base"), E.time_of(j, "ts", "timestamp", "time"), sid, drafts),
    )


def _store_messages(raw: DataFrame, tool: str, times: tuple[str, ...]) -> DataFrame:
    """Sessions and messages from a store, results already beside their calls."""
    j = J("j")
    r = E.records(raw).withColumns({"object": V.is_object(j), "role": V.text(j, "role"), "start": V.text(j, "kind") == "session_start", "base": F.coalesce(V.text(j, "id"), E.content_id(J("line")))})
    base = J("base")
    r = r.withColumn("what", F.when(~J("object"), "unknown").when(J("start"), "start").when(V.has(j, "role"), F.when(V.one_of(J("role"), ("user", "assistant")), "message").otherwise("odd")).otherwise("unknown"))
    opened = F.coalesce(_id(V.text(j, "sessionId"), ":start"), E.content_id(J("line")))
    text = F.coalesce(V.text(j, "text"), F.lit(""))
    start = E.draft("session_start", opened, cwd=F.lit("."), model=V.text(j, "model") if tool == "hermes" else E.null(), own_ts=E.time_of(j, *times))
    turn = E.draft(F.when(J("role") == "user", "user_turn").otherwise("assistant_turn"), base, text=text, parts=F.array(E.part("text", text=text)))

    def pair(c: Column, i: Column) -> Column:
        cid = F.coalesce(V.text(c, "id"), _id(base, ":tool:", _n(i)))
        found = F.get(F.filter(V.items_or_none(j, "toolResults"), lambda x: F.coalesce(V.text(x, "id") == cid, F.lit(False))), F.lit(0))
        key = lambda kind: _id(cid, ":", kind)
        both = F.concat(
            E.drafts(E.draft("tool_call", key("call"), once=key("call"), parent_id=base, call_id=cid, name=F.coalesce(V.text(c, "name"), F.lit("")), args=V.json(c, "args"))),
            E.only(found.isNotNull(), E.drafts(E.draft("tool_result", key("result"), once=key("result"), parent_id=base, call_id=cid, ok=F.coalesce(V.boolean(found, "ok"), F.lit(True)), output=V.json(found, "output")))),
        )
        return E.only(V.is_object(c), both)

    calls = F.coalesce(F.flatten(F.transform(V.items(j, "toolCalls"), pair)), E.none())
    drafts = F.when(J("what") == "start", E.drafts(start)).when(J("what") == "message", F.concat(E.drafts(turn), calls)).otherwise(_unknowns())
    rid = F.when(J("what") == "start", opened).when(J("what").isin("message", "odd"), base)
    sid = F.when(J("what") == "start", V.text(j, "sessionId"))
    return E.finish(_parsed(r, rid, E.time_of(j, "ts", "timestamp"), sid, drafts, sid_start=J("what") == "start"), tool, "follow")


def hermes(raw: DataFrame) -> DataFrame:
    return _store_messages(raw, "hermes", ("ts", "timestamp", "started_at"))


def opencode(raw: DataFrame) -> DataFrame:
    return _store_messages(raw, "opencode", ("ts", "timestamp"))


#: The normalizer of each tool. Add to it, or pass another, to take in other formats.
NORMALIZERS: dict[str, Callable[[DataFrame], DataFrame]] = {f.__name__: f for f in (claude_code, codex, gemini, otel, cursor, windsurf, zed, vscode, copilot, hermes, opencode)}


def normalize(raw: DataFrame, tool: str, registry: dict[str, Callable[[DataFrame], DataFrame]] = NORMALIZERS) -> DataFrame:
    return registry[tool](raw)


def fingerprint(tool: str, line: Column) -> Column:
    """struct<source, variant, confidence> of a sample record, as one tool sees it; confidence 0 where it isn't its own."""
    v = V.parse(T.trim(line))
    role, kind = V.text(v, "role"), V.text(v, "kind")
    start = F.coalesce(kind == "session_start", F.lit(False))
    version = V.text(v, "version")
    keyed = lambda *keys: V.any_of(*[V.has(v, k) for k in keys])
    dotted = F.exists(F.map_keys(F.when(V.is_object(v), F.try_variant_get(v, "$", "map<string,variant>"))), lambda k: k.startswith("gen_ai."))
    rules: dict[str, list[tuple[Column, Column | str, int]]] = {
        "claude_code": [(V.text(v, "type").isNotNull() & keyed("uuid", "parentUuid", "sessionId", "message"), F.when(version.startswith("2."), "claude_code/2.0").when(version.isNotNull(), "claude_code/1.x").otherwise("claude_code/unknown"), 100)],
        "codex": [(V.text(v, "type").isNotNull() & V.has(v, "payload"), "codex/rollout-v2", 100)],
        "gemini": [(keyed("$set", "$rewindTo"), "gemini/control", 100), (V.has(v, "role"), "gemini/chat-v1", 100)],
        "otel": [(F.exists(V.items(v, "attributes"), lambda e: V.has(e, "key")), "otel/genai-otlp", 100), (dotted, "otel/genai-flat", 100)],
        "cursor": [(V.is_object(v) & (V.has(v, "role") | start), "cursor/vscdb-v1", 100)],
        "windsurf": [(start | role.isNotNull(), "windsurf/cascade-export-v1", 100)],
        "zed": [(start | (V.has(v, "role") & keyed("toolCalls", "toolResults", "edits", "threadId", "sessionId")), "zed/threads-db-v1", 100)],
        "vscode": [(V.items(v, "requests").isNotNull(), "vscode/chat-sessions-native", 100), (start | role.isNotNull(), "vscode/exported-jsonl-v1", 100)],
        "copilot": [(start, "copilot/export-v1", 100), (role.isNotNull() & V.text(v, "id").isNotNull(), "copilot/export-v1", 80)],
        "hermes": [(start, "hermes/session-v1", 100), (V.has(v, "role"), "hermes/chat-v1", 100)],
        "opencode": [(start, "opencode/session-v1", 100), (V.has(v, "role"), "opencode/message-v1", 100)],
    }
    variant, sure = F.lit("unknown"), F.lit(0)
    for condition, name, confidence in reversed(rules[tool]):
        variant, sure = F.when(condition, name).otherwise(variant), F.when(condition, confidence).otherwise(sure)
    return F.struct(F.lit(tool).alias("source"), variant.alias("variant"), sure.alias("confidence"))
