"""Databases of editors and agents, read where they lie and turned into the lines that their normalizers take.

A Python data source opens each SQLite file read-only and unchanged, one partition a
file; everything after that (order, joins of calls with results and of parts with
messages, JSON) is DataFrame operations. Files must be readable on the executors.
"""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import variant as V


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class SqliteRows(DataSource):
    """Rows of one query over many files: options paths (JSON list), query; the schema's first column is the file.

    Files that aren't there, that lack a table or column, or that can't be opened give no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite_rows"

    def reader(self, schema):
        return _Reader(json.loads(self.options["paths"]), self.options["query"])


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], query: str):
        self.paths, self.query = paths, query

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition) -> Iterator[tuple]:
        try:
            db = sqlite3.connect(f"file:{partition.path}?mode=ro&immutable=1", uri=True)
        except sqlite3.OperationalError:
            return
        db.text_factory = lambda b: b.decode("utf-8", "replace")
        try:
            for row in db.execute(self.query):
                yield (partition.path, *row)
        except sqlite3.DatabaseError:
            return
        finally:
            db.close()


def sqlite_rows(spark: SparkSession, paths: list[str], query: str, schema: str) -> DataFrame:
    """file and the columns of schema, by a query over each file."""
    spark.dataSource.register(SqliteRows)
    return spark.read.format("sqlite_rows").schema(f"file string, {schema}").option("paths", json.dumps(paths)).option("query", query).load()


def _raw(df: DataFrame, *order: Column | str) -> DataFrame:
    """run_id, line_no, byte_offset, line of rows (file, line) in this order within their file."""
    return df.select(F.col("file").alias("run_id"), F.row_number().over(W.partitionBy("file").orderBy(*order)).cast("bigint").alias("line_no"), F.lit(0).cast("bigint").alias("byte_offset"), "line")


def _json(*fields: Column) -> Column:
    """A JSON object without the fields that are null."""
    return F.to_json(F.struct(*fields))


def _value(text: Column) -> Column:
    """JSON text as Variant, so that to_json() keeps it as JSON."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.lit("null")))


KEYS = "SELECT key, CAST(value AS TEXT) FROM cursorDiskKV WHERE key LIKE 'composerData:%' OR key LIKE 'bubbleId:%'"
# Tools that edit files.
EDIT_PARTS, EDIT_NAMES = ("edit_file", "search_replace", "create_file", "apply_patch", "apply_diff"), ("write", "reapply")


def cursor(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Chats: a header for each, then its bubbles in the order of the chat's headers, else by time and id."""
    rows = sqlite_rows(spark, paths, KEYS, "key string, value string").withColumn("j", V.parse(F.col("value")))
    j = F.col("j")
    chats = rows.where("key LIKE 'composerData:%'").withColumn("cid", V.filled(j, "composerId")).where("cid IS NOT NULL")
    order = F.filter(F.transform(V.items_or_none(j, "fullConversationHeadersOnly"), lambda h: V.text(h, "bubbleId")), lambda b: b.isNotNull())
    name = F.when(V.filled(j, "name") != "None", V.filled(j, "name"))
    made = F.coalesce(F.timestamp_millis(V.whole(j, "createdAt")), F.timestamp_seconds(F.lit(0)))
    chats = chats.select("file", "cid", order.alias("order"), name.alias("name"), made.alias("made"))
    ts = F.date_format("made", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    header = _json(F.lit("session_start").alias("kind"), F.col("cid").alias("sessionId"), F.col("cid").alias("composerId"), F.col("name"), ts.alias("ts"), F.lit("cursor").alias("toolVersion"))
    heads = chats.select("file", "cid", F.lit(-1).alias("rank"), F.lit("").alias("at"), F.lit("").alias("bid"), header.alias("line"))
    bubbles = rows.where("key LIKE 'bubbleId:%'").withColumn("rest", F.substr("key", F.lit(10)))
    bubbles = bubbles.join(chats.select("file", "cid", "order"), "file").where(F.startswith("rest", F.concat("cid", F.lit(":")))).withColumn("bid", F.expr("substr(rest, length(cid) + 2)"))
    place = F.array_position("order", F.col("bid"))
    kind = F.coalesce(V.whole(j, "type"), F.trim(V.text(j, "type")).try_cast("bigint"), F.lit(0))
    role = F.when(kind == 1, "user").when(kind == 2, "assistant").otherwise("unknown")
    tool = V.get(j, "toolFormerData")
    called = F.coalesce(V.text(tool, "name"), F.lit(""))
    call = F.coalesce(V.filled(tool, "toolCallId"), V.text(tool, "modelCallId"), F.concat(F.lit("toolcall:"), called))
    inner = lambda k: F.coalesce(V.parse(V.filled(tool, k)), V.parse(V.quoted(V.filled(tool, k))))
    args, params = inner("rawArgs"), inner("params")
    given = lambda v: F.when(V.type_of(v) != "VOID", v)
    path = F.coalesce(V.filled(args, "path"), V.filled(params, "relativeWorkspacePath"), V.filled(params, "path"), V.filled(args, "relativeWorkspacePath"), V.filled(args, "target_file"), V.filled(params, "targetFile"))
    edits = V.any_of(*[called.contains(p) for p in EDIT_PARTS]) | called.isin(*EDIT_NAMES)
    there = V.is_object(tool)
    null = F.try_parse_json(F.lit("null"))
    calls = F.when(there, F.array(F.struct(call.alias("id"), called.alias("name"), F.coalesce(given(args), given(params), null).alias("args"))))
    results = F.when(there, F.array(F.struct(call.alias("id"), (~F.coalesce(V.text(tool, "status").isin("error", "cancelled"), F.lit(False))).alias("ok"), F.coalesce(inner("result"), null).alias("output"))))
    changed = F.when(there & edits & path.isNotNull(), F.array(F.struct(path.alias("path"), call.alias("callId"), V.text(args, "streamContent").alias("newText"))))
    created = F.coalesce(V.text(j, "createdAt"), F.lit("1970-01-01T00:00:00Z"))
    line = _json(
        F.col("bid").alias("id"), role.alias("role"), created.alias("ts"), F.col("cid").alias("sessionId"), F.col("cid").alias("composerId"), F.col("bid").alias("bubbleId"),
        F.coalesce(V.filled(j, "text"), V.filled(j, "richText"), F.lit("")).alias("text"), calls.alias("toolCalls"), results.alias("toolResults"), changed.alias("edits"),
    )
    body = bubbles.select("file", "cid", F.when(place > 0, place).otherwise(1 << 30).cast("int").alias("rank"), F.coalesce(V.text(j, "createdAt"), F.lit("")).alias("at"), "bid", line.alias("line"))
    return _raw(heads.unionByName(body), "cid", "rank", "at", "bid")


def vscode(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Chat sessions: a user's and an assistant's line for each request."""
    rows = sqlite_rows(spark, paths, "SELECT CAST(value AS TEXT) FROM ItemTable WHERE key = 'interactive.sessions'", "value string")
    sessions = rows.select("file", F.posexplode(V.items(V.parse(F.col("value")))).alias("si", "s"))
    s = F.col("s")
    sid = F.coalesce(V.filled(s, "sessionId"), F.concat(F.lit("vscode-"), F.substring(F.sha2(F.to_json(s), 256), 1, 16)))
    number = lambda v, k: F.coalesce(V.whole(v, k), F.trim(V.text(v, k)).try_cast("bigint"), F.try_variant_get(V.get(v, k), "$", "double").cast("bigint"))
    sessions = sessions.select("file", "si", "s", sid.alias("sid"), F.coalesce(number(s, "creationDate"), number(s, "lastMessageDate")).alias("sts"), V.filled(s, "responderUsername").alias("model"), V.items(s, "requests").alias("requests"))
    whole = sessions.where("requests IS NULL").select("file", "si", F.lit(0).alias("ri"), F.lit(0).alias("part"), F.to_json("s").alias("line"))
    q = F.col("q")
    asked = sessions.where("requests IS NOT NULL").select("file", "si", "sid", "sts", "model", F.posexplode("requests").alias("ri", "q")).where(V.is_object(q))
    rid = F.coalesce(V.filled(q, "requestId"), F.concat("sid", F.lit(":req:"), "ri"))
    asked = asked.withColumns({"rid": rid, "ts": F.coalesce(number(q, "timestamp"), F.col("sts"))})
    spoken = lambda parts: F.array_join(F.filter(F.transform(parts, lambda x: F.when(V.text(x, "kind") == "text", V.filled(x, "text"))), lambda t: t.isNotNull()), "")
    message = V.get(q, "message")
    said = F.coalesce(V.filled(message, "text"), spoken(V.items(message, "parts")), F.lit(""))
    user = _json(F.concat("rid", F.lit(":user")).alias("id"), F.lit("user").alias("role"), F.col("sid").alias("sessionId"), "ts", said.alias("text"))
    parts = F.filter(V.items_or_none(q, "response"), V.is_object)
    kind = lambda x: V.text(x, "kind")
    markdown = lambda x: F.coalesce(V.text(x, "value"), V.text(x, "content"), V.text(x, "content", "value"))
    response = V.get(q, "response")
    text = F.when(V.is_array(response), V.lines_joined(F.transform(F.filter(parts, lambda x: F.coalesce(kind(x) == "markdownContent", ~V.has(x, "kind") | kind(x).isNull())), markdown), "\n\n"))
    text = F.coalesce(text, V.text_of(response), F.when(V.is_object(response), markdown(response)), F.lit(""))
    nested = lambda x, k: F.coalesce(V.filled(x, k), V.filled(x, k, "value"))
    tools = F.filter(parts, lambda x: V.one_of(kind(x), ("toolInvocationSerialized", "prepareToolInvocation")))

    def call(x: Column, i: Column) -> Column:
        cid = F.coalesce(F.when(V.has(x, "toolCallId"), V.filled(x, "toolCallId")).otherwise(V.filled(x, "toolId")), F.concat(F.lit("tool:"), i.cast("string")))
        name = F.coalesce(F.when(V.has(x, "toolId"), V.filled(x, "toolId")).otherwise(V.filled(x, "toolName")), nested(x, "invocationMessage"), nested(x, "pastTenseMessage"), F.lit(""))
        args = F.struct(nested(x, "invocationMessage").alias("invocationMessage"), nested(x, "pastTenseMessage").alias("pastTenseMessage"), V.boolean(x, "isComplete").alias("isComplete"))
        return F.struct(cid.alias("id"), name.alias("name"), args.alias("args"))

    one_path = lambda v: F.coalesce(V.filled(v), F.when(V.has(v, "path"), V.filled(v, "path")).otherwise(V.filled(v, "fsPath")))
    uri = lambda v: F.coalesce(V.text_of(v), F.nullif(one_path(v), F.lit("")), one_path(V.get(v, "uri")))
    path = lambda x: F.coalesce(F.nullif(uri(V.get(x, "uri")), F.lit("")), F.nullif(uri(V.get(x, "resource")), F.lit("")))
    ops = lambda x: F.nullif(F.to_json(F.when(V.has(x, "edits"), V.get(x, "edits")).otherwise(V.get(x, "textEdits"))), F.lit("null"))
    changed = F.filter(parts, lambda x: V.one_of(kind(x), ("textEditGroup", "codeblockUri", "inlineReference")) & path(x).isNotNull())
    calls, edits = F.transform(tools, call), F.transform(changed, lambda x: F.struct(path(x).alias("path"), ops(x).alias("diff")))
    answer = F.coalesce(V.filled(q, "responseId"), F.concat("rid", F.lit(":resp")))
    some = lambda a: F.when(F.size(a) > 0, a)
    assistant = _json(F.concat(answer, F.lit(":asst")).alias("id"), F.concat("rid", F.lit(":user")).alias("parentId"), F.lit("assistant").alias("role"), F.col("sid").alias("sessionId"), "ts", text.alias("text"), "model", some(calls).alias("toolCalls"), some(edits).alias("edits"))
    both = asked.select("file", "si", "ri", F.posexplode(F.array(user, assistant)).alias("part", "line"))
    return _raw(whole.unionByName(both), "si", "ri", "part")


def zed_blob(kind: str, data: bytes | None) -> str | None:
    """The JSON text of a thread: as its label or its first bytes say, compressed or not; null if neither reads."""
    import zstandard

    def packed() -> str | None:
        try:
            text = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(data).decode()
            json.loads(text)
            return text
        except (zstandard.ZstdError, ValueError):
            return None

    def plain() -> str | None:
        try:
            json.loads(data)
            return data.decode()
        except ValueError:
            return None

    if not data:
        return None
    if kind.lower() == "zstd" or data[:4] == b"\x28\xb5\x2f\xfd":
        return packed() or plain()
    return plain() or packed()


def zed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Threads by time of change and id: a header for each, then its messages."""
    fields = "id, coalesce(summary, '') AS summary, coalesce(updated_at, '') AS updated_at, coalesce(data_type, '') AS data_type, CAST(data AS BLOB) AS data"
    wide = sqlite_rows(spark, paths, f"SELECT {fields}, created_at FROM threads", "id string, summary string, updated_at string, data_type string, data binary, created_at string")
    # Older stores have no created_at; the first query gives no rows of theirs.
    old = sqlite_rows(spark, paths, f"SELECT {fields}, NULL FROM threads WHERE NOT EXISTS (SELECT 1 FROM pragma_table_info('threads') WHERE lower(name) = 'created_at')", "id string, summary string, updated_at string, data_type string, data binary, created_at string")

    @F.pandas_udf("string")
    def text(kind: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([zed_blob(k, d) for k, d in zip(kind, data, strict=True)], dtype=object)

    t = wide.unionByName(old).withColumn("blob", text("data_type", "data")).withColumn("j", V.parse(F.col("blob")))
    j = F.col("j")
    provider, model = F.coalesce(V.text(j, "model", "provider"), F.lit("")), F.coalesce(V.text(j, "model", "model"), V.text(j, "model", "id"))
    thread_model = F.coalesce(F.when(V.is_object(V.get(j, "model")), F.when(provider == "", model).otherwise(F.concat(provider, F.lit("/"), model))).otherwise(V.first_text(j, "model", "model_id")))
    updated = F.nullif(F.col("updated_at"), F.lit(""))
    header = _json(
        F.lit("session_start").alias("kind"), F.col("id").alias("sessionId"), F.coalesce(F.nullif("created_at", F.lit("")), updated).alias("ts"), F.coalesce(V.first_filled(j, "summary", "title"), F.nullif("summary", F.lit(""))).alias("summary"),
        thread_model.alias("model"), F.coalesce(F.concat(F.lit("zed/"), V.text(j, "version")), F.lit("zed")).alias("toolVersion"),
    )
    heads = t.select("file", "updated_at", "id", F.lit(-1).alias("i"), header.alias("line"))
    messages = V.items(j, "messages")
    some = F.coalesce(F.size(messages) > 0, F.lit(False))
    said = t.where(some).select("file", "updated_at", "id", updated.alias("ts"), F.posexplode(messages).alias("i", "m"))
    m = F.col("m")
    tagged = F.coalesce(F.when(V.is_object(V.get(m, "User")), F.lit("user")), F.when(V.is_object(V.get(m, "Agent")), F.lit("assistant")))
    named = V.text(m, "role")
    role = F.coalesce(tagged, F.when(named.isin("user", "User"), "user").when(named.isin("assistant", "Assistant", "Agent"), "assistant").otherwise(named))
    body = F.when(tagged == "user", V.get(m, "User")).when(tagged == "assistant", V.get(m, "Agent")).otherwise(m)
    said = said.withColumns({"role": role, "b": body}).where("role IS NOT NULL")
    b = F.col("b")
    as_id = lambda v: F.coalesce(V.text_of(v), F.when(V.type_of(v).isin("BIGINT", "DOUBLE") | V.type_of(v).startswith("DECIMAL"), F.to_json(v)))
    own = F.coalesce(F.nullif(as_id(V.get(b, "id")), F.lit("")), F.col("i").cast("string"))
    content, segments = V.items(b, "content"), V.items(b, "segments")
    spoken = lambda x: F.coalesce(V.text_of(x), V.text(x, "Text"))
    thought = lambda x: F.when(V.text(x, "Text").isNull(), F.coalesce(V.text(x, "Thinking"), V.text(x, "Thinking", "text")))
    chunk = lambda x: F.when(V.is_object(x), F.coalesce(V.text(x, "text"), V.text(x, "content")))
    thinks = lambda x: V.one_of(V.text(x, "type"), ("thinking", "redacted_thinking"))
    joined = lambda of_content, of_segment: F.when(content.isNotNull(), V.lines_joined(F.transform(content, of_content))).when(segments.isNotNull(), V.lines_joined(F.transform(segments, of_segment)))
    text_ = F.coalesce(F.nullif(joined(spoken, lambda x: F.when(~thinks(x), chunk(x))), F.lit("")), V.text(b, "text"), V.text(b, "content"), F.lit(""))
    thinking = F.coalesce(F.nullif(joined(thought, lambda x: F.when(thinks(x), chunk(x))), F.lit("")), V.filled(b, "thinking"))
    uses = F.filter(F.transform(V.items_or_none(b, "content"), lambda x: V.get(x, "ToolUse")), V.is_object)
    listed = F.filter(F.coalesce(V.items(b, "tool_uses"), V.items_or_none(b, "toolUses")), V.is_object)
    uses = F.when(F.size(uses) > 0, uses).otherwise(listed)
    null = F.try_parse_json(F.lit("null"))

    def call(u: Column, i: Column) -> Column:
        cid = F.coalesce(F.nullif(as_id(V.get(u, "id")), F.lit("")), F.concat(F.lit("toolcall"), i.cast("string")))
        args = F.coalesce(F.when(V.type_of(V.get(u, "input")) != "VOID", V.get(u, "input")), V.parse(V.filled(u, "raw_input")), V.get(u, "args"), V.get(u, "arguments"), null)
        return F.struct(cid.alias("id"), F.coalesce(V.text(u, "name"), F.lit("")).alias("name"), args.alias("args"))

    said = said.withColumn("calls", F.transform(uses, call))

    def hunk(path: Column, h: Column, cid: Column) -> Column:
        first = lambda *keys: V.text_of(F.coalesce(*[V.get(h, k) for k in keys]))
        return F.struct(path.alias("path"), first("old_text", "old_string", "oldText").alias("oldText"), first("new_text", "new_string", "newText", "content").alias("newText"), first("diff", "patch").alias("diff"), cid.alias("callId"))

    def edits_of(c: Column) -> Column:
        a, low = c["args"], F.lower(c["name"])
        edit = V.any_of(*[low.contains(x) for x in ("edit", "create_file", "write", "str_replace", "apply_patch", "replace")])
        path = V.text_of(F.coalesce(*[V.get(a, k) for k in ("path", "file_path", "abs_path", "filePath")]))
        subs = F.filter(V.items_or_none(a, "edits"), V.is_object)
        many = F.transform(subs, lambda h: hunk(path, h, c["id"]))
        return F.when(edit & path.isNotNull(), F.when(F.size(subs) > 0, many).otherwise(F.array(hunk(path, a, c["id"]))))

    edits = F.flatten(F.filter(F.transform("calls", edits_of), lambda x: x.isNotNull()))
    raw_results = F.coalesce(V.get(b, "tool_results"), V.get(b, "toolResults"))

    def result(r: Column, default: Column) -> Column:
        cid = F.coalesce(F.nullif(as_id(F.coalesce(V.get(r, "tool_use_id"), V.get(r, "toolUseId"), V.get(r, "id"))), F.lit("")), default)
        failed = F.coalesce(V.boolean(r, "is_error"), V.boolean(r, "isError"))
        return F.struct(cid.alias("id"), F.coalesce(~failed, V.boolean(r, "ok"), F.lit(True)).alias("ok"), F.coalesce(V.get(r, "output"), V.get(r, "content"), null).alias("output"))

    by_key = F.transform(V.entries(raw_results), lambda e: F.struct(e["key"].alias("key"), V.parse(e["value"]).alias("value")))
    by_key = F.transform(F.filter(by_key, lambda e: V.is_object(e["value"])), lambda e: result(e["value"], e["key"]))
    listed = F.transform(V.items_or_none(raw_results), lambda r, i: F.when(V.text_of(r) != "", F.struct(V.text_of(r).alias("id"), F.lit(True).alias("ok"), null.alias("output"))).when(V.is_object(r), result(r, F.concat(F.lit("toolresult"), i.cast("string")))))
    results = F.when(V.is_object(raw_results), by_key).otherwise(F.filter(listed, lambda r: r.isNotNull()))
    some_of = lambda a: F.when(F.size(a) > 0, a)
    used = V.get(b, "usage")
    assistant = F.col("role") == "assistant"
    usage = F.struct(V.first_natural(used, "input_tokens", "input").alias("input"), V.first_natural(used, "output_tokens", "output").alias("output"))
    line = _json(
        F.concat("id", F.lit(":msg:"), own).alias("id"), "role", F.col("id").alias("sessionId"), F.col("id").alias("threadId"), F.coalesce(V.first_text(b, "timestamp", "created_at"), F.col("ts")).alias("ts"), text_.alias("text"), thinking.alias("thinking"),
        F.when(assistant, V.first_text(b, "model", "model_id")).alias("model"), F.when(assistant & V.is_object(used), usage).alias("usage"), some_of(F.col("calls")).alias("toolCalls"), some_of(edits).alias("edits"), some_of(results).alias("toolResults"),
    )
    lines = said.select("file", "updated_at", "id", "i", line.alias("line"))
    odd = (j.isNotNull() & ~V.has(j, "messages")) | (j.isNull() & (F.length("data") > 0))
    lost = t.where(odd).select("file", "updated_at", "id", F.lit(0).alias("i"), F.when(j.isNotNull(), _json(F.lit("zed_thread_blob").alias("kind"), F.col("id").alias("sessionId"), j.alias("data"))).otherwise(_json(F.lit("zed_thread_blob").alias("kind"), F.col("id").alias("sessionId"), F.col("data_type").alias("dataType"), F.length("data").alias("byteLen"))).alias("line"))
    return _raw(heads.unionByName(lines).unionByName(lost), "updated_at", "id", "i")


def hermes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Sessions and messages; what a tool said stands beside the call that it answers, within the session."""
    sessions = sqlite_rows(spark, paths, "SELECT CAST(id AS TEXT), model, CAST(started_at AS TEXT), title FROM sessions", "sid string, model string, started_at string, title string")
    messages = sqlite_rows(spark, paths, "SELECT id, CAST(session_id AS TEXT), role, content, tool_call_id, tool_calls, CAST(timestamp AS TEXT) FROM messages", "mid bigint, sid string, role string, content string, tool_call_id string, tool_calls string, ts string")
    heads = sessions.select("file", "sid", F.lit(None).cast("bigint").alias("mid"), _json(F.lit("session_start").alias("kind"), F.col("sid").alias("sessionId"), "model", F.col("started_at").alias("ts"), "title").alias("line"))
    answers = messages.where("role = 'tool' AND tool_call_id IS NOT NULL AND content IS NOT NULL").groupBy("file", "sid", F.col("tool_call_id").alias("cid")).agg(F.max_by("content", "mid").alias("output"))
    said = messages.where("role <> 'tool'").join(sessions.select("file", "sid"), ["file", "sid"], "left_semi")
    listed = V.items(V.parse(F.col("tool_calls")))
    c = F.col("c")
    calls = said.select("file", "sid", "mid", F.posexplode(F.filter(listed, V.is_object)).alias("i", "c"))
    args = F.coalesce(V.get(c, "arguments"), V.get(c, "args"), V.get(c, "function", "arguments"), F.try_parse_json(F.lit("null")))
    calls = calls.select("file", "sid", "mid", "i", F.coalesce(V.text(c, "id"), F.concat("sid", F.lit(":"), "mid", F.lit(":call"))).alias("cid"), F.coalesce(V.text_of(F.coalesce(V.get(c, "name"), V.get(c, "function", "name"))), F.lit("")).alias("name"), F.to_json(args).alias("args"))
    met = calls.join(answers, ["file", "sid", "cid"], "left")
    lists = met.groupBy("file", "sid", "mid").agg(F.array_sort(F.collect_list(F.struct("i", "cid", "name", "args", "output"))).alias("calls"))
    whole = said.join(lists, ["file", "sid", "mid"], "left")
    own = F.transform("calls", lambda x: F.struct(x["cid"].alias("id"), x["name"].alias("name"), _value(x["args"]).alias("args")))
    got = F.transform(F.filter("calls", lambda x: x["output"].isNotNull()), lambda x: F.struct(x["cid"].alias("id"), F.lit(True).alias("ok"), x["output"].alias("output")))
    line = _json(F.concat("sid", F.lit(":"), "mid").alias("id"), F.col("sid").alias("sessionId"), "role", F.coalesce("content", F.lit("")).alias("text"), "ts", own.alias("toolCalls"), F.when(F.size(got) > 0, got).alias("toolResults"))
    return _raw(heads.unionByName(whole.select("file", "sid", "mid", line.alias("line"))), "sid", F.col("mid").asc_nulls_first())


def opencode(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Sessions and messages, each with its parts in order of their id."""
    sessions = sqlite_rows(spark, paths, "SELECT CAST(id AS TEXT), title, time_created FROM session", "sid string, title string, ts bigint")
    messages = sqlite_rows(spark, paths, "SELECT CAST(id AS TEXT), CAST(session_id AS TEXT), data, time_created FROM message", "mid string, sid string, data string, ts bigint")
    parts = sqlite_rows(spark, paths, "SELECT CAST(id AS TEXT), CAST(message_id AS TEXT), CAST(session_id AS TEXT), data FROM part", "pid string, mid string, sid string, data string")
    heads = sessions.select("file", "sid", F.lit("").alias("mid"), _json(F.lit("session_start").alias("kind"), F.col("sid").alias("sessionId"), "ts", "title").alias("line"))
    p = F.col("p")
    read = parts.withColumn("p", V.parse(F.col("data"))).withColumn("kind", V.text(p, "type")).where("kind IN ('text', 'tool')")
    status = V.text(p, "state", "status")
    output = F.when(status == "completed", V.json(p, "state", "output")).when(status == "error", V.json(p, "state", "error"))
    read = read.select("file", "sid", "mid", "pid", "kind", V.text(p, "text").alias("text"), F.coalesce(V.text(p, "callID"), F.lit("")).alias("cid"), F.coalesce(V.text(p, "tool"), F.lit("")).alias("name"), V.json(p, "state", "input").alias("args"), (status == "completed").alias("ok"), output.alias("output"))
    lists = read.groupBy("file", "sid", "mid").agg(F.array_sort(F.collect_list(F.struct("pid", "kind", "text", "cid", "name", "args", "ok", "output"))).alias("parts"))
    role = V.text(V.parse(F.col("data")), "role")
    said = messages.withColumn("role", role).where("role IS NOT NULL").join(sessions.select("file", "sid"), ["file", "sid"], "left_semi").join(lists, ["file", "sid", "mid"], "left")
    tools = F.filter("parts", lambda x: x["kind"] == "tool")
    text = F.coalesce(V.lines_joined(F.transform(F.filter("parts", lambda x: x["kind"] == "text"), lambda x: x["text"])), F.lit(""))
    calls = F.transform(tools, lambda x: F.struct(x["cid"].alias("id"), x["name"].alias("name"), _value(x["args"]).alias("args")))
    results = F.transform(F.filter(tools, lambda x: x["output"].isNotNull()), lambda x: F.struct(x["cid"].alias("id"), x["ok"].alias("ok"), _value(x["output"]).alias("output")))
    some = lambda a: F.when(F.size(a) > 0, a)
    line = _json(F.concat("sid", F.lit(":"), "mid").alias("id"), F.col("sid").alias("sessionId"), "role", text.alias("text"), "ts", some(calls).alias("toolCalls"), some(results).alias("toolResults"))
    return _raw(heads.unionByName(said.select("file", "sid", "mid", line.alias("line"))), "sid", "mid")


READERS = {"cursor": cursor, "vscode": vscode, "zed": zed, "hermes": hermes, "opencode": opencode}
DATABASES = (".vscdb", ".db")


def read_store(spark: SparkSession, tool: str, paths: list[str]) -> DataFrame:
    """Raw records of a tool's files: databases by their reader, whole documents or lines otherwise."""
    from .lines import read_documents, read_lines

    native = [p for p in paths if tool in READERS and p.lower().endswith(DATABASES)]
    rest = [p for p in paths if p not in native]
    some = [READERS[tool](spark, native)] if native else []
    if rest:
        some.append(read_documents(spark, rest) if tool == "vscode" else read_lines(spark, rest))
    if not some:
        return spark.createDataFrame([], "run_id string, line_no bigint, byte_offset bigint, line string")
    return some[0] if len(some) == 1 else some[0].unionByName(some[1])
