"""From raw records to the events relation: what all tools share.

A tool's normalizer turns each record into an array of drafts (structs of FIELDS) with
Column expressions only. finish() then numbers, drops repeats and carries session and
project along each file; everything there is a window within one file, so one shuffle
by file serves all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import variant as V

SCHEMA_VERSION = 1
PART = "struct<part:string,text:string,call_id:string,name:string,args:string,output:string,media_type:string,raw:string>"
USAGE = "struct<input_tokens:bigint,output_tokens:bigint,cache_read_tokens:bigint,cache_creation_tokens:bigint>"
GIT = "struct<sha:string,branch:string>"
PROJECT = f"struct<cwd:string,repo_root:string,git:{GIT}>"
#: What an event can hold. once: a key that only the first event of a file keeps; null is always kept.
FIELDS = {
    "kind": "string", "event_id": "string", "once": "string", "parent_id": "string", "own_ts": "timestamp", "text": "string", "thinking": "string", "model": "string",
    "parts": f"array<{PART}>", "usage": USAGE, "call_id": "string", "name": "string", "args": "string", "ok": "boolean", "output": "string", "path": "string",
    "old": "string", "new": "string", "unified": "string", "added": "bigint", "removed": "bigint", "to_event": "string", "first": "bigint", "last": "bigint",
    "reason": "string", "cwd": "string", "git": GIT, "tool_version": "string", "raw_type": "string", "raw": "string",
}
DRAFT = "struct<" + ",".join(f"{k}:{t}" for k, t in FIELDS.items()) + ">"
DRAFTS = f"array<{DRAFT}>"
U32 = 4294967295
UNKNOWN_TIMES = ("timestamp", "time", "ts", "created_at")


def null() -> Column:
    return F.lit(None)


def content_id(text: Column) -> Column:
    """A hash of the content, 64 hex digits."""
    return F.sha2(text, 256)


def draft(kind: str | Column, event_id: Column, **fields: Column) -> Column:
    """One event with the given fields; the others are null. once defaults to nothing."""
    given = {"kind": F.lit(kind) if isinstance(kind, str) else kind, "event_id": event_id} | fields
    return F.struct(*[(given[k] if k in given else F.lit(None)).cast(t).alias(k) for k, t in FIELDS.items()])


def part(kind: str, **fields: Column) -> Column:
    names = [f.split(":")[0] for f in PART[7:-1].split(",")]
    given = {"part": F.lit(kind)} | fields
    return F.struct(*[(given[n] if n in given else F.lit(None)).cast("string").alias(n) for n in names])


def drafts(*some: Column) -> Column:
    return F.array(*some).cast(DRAFTS)


def none() -> Column:
    return F.array().cast(DRAFTS)


def only(condition: Column, some: Column) -> Column:
    return F.when(condition, some).otherwise(none())


def each(elements: Column, make) -> Column:
    """A draft of each element: make(element, index)."""
    return F.coalesce(F.transform(elements, make).cast(DRAFTS), none())


def usage(*columns: Column | None) -> Column:
    names = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")
    return F.struct(*[(F.lit(None) if c is None else c).cast("bigint").alias(n) for n, c in zip(names, columns, strict=True)])


def git_ref(sha: Column, branch: Column) -> Column:
    return F.when(sha.isNotNull(), F.struct(sha.alias("sha"), branch.alias("branch")))


def project(cwd: Column, git: Column, repo_root: Column | None = None) -> Column:
    return F.struct(cwd.alias("cwd"), (F.lit(None) if repo_root is None else repo_root).cast("string").alias("repo_root"), git.cast(GIT).alias("git")).cast(PROJECT)


def time_of(v: Column, *keys: str) -> Column:
    """The first of some keys that holds a readable time (a text or a whole number), else the epoch."""
    one = lambda k: T.parse_ts(F.coalesce(V.text(v, k), V.whole(v, k).cast("string")))
    return F.coalesce(*[one(k) for k in keys], F.timestamp_seconds(F.lit(0)))


def at_most_u32(n: Column) -> Column:
    return F.least(n, F.lit(U32))


def records(raw: DataFrame) -> DataFrame:
    """raw (run_id, line_no, byte_offset, line) with body (trimmed) and j (Variant); blank lines go."""
    body = T.trim(F.col("line"))
    return raw.select("run_id", "line_no", "byte_offset", "line", body.alias("body")).where("body <> ''").withColumn("j", V.parse(F.col("body")))


def unknown(v: Column, raw: Column) -> Column:
    """An event that keeps a record as it is: no repeat is ever dropped."""
    return draft("unknown", content_id(F.col("line")), own_ts=time_of(v, *UNKNOWN_TIMES), raw_type=F.coalesce(V.text(v, "type"), F.lit("unknown")), raw=raw)


def unknown_record() -> Column:
    """The record itself, as JSON: text that is none becomes a JSON string."""
    return unknown(F.col("j"), F.when(F.col("j").isNotNull(), F.col("body")).otherwise(V.quoted(F.col("body"))))


def finish(parsed: DataFrame, tool: str, session: str = "latch", project_first: bool = False, gaps: bool = False) -> DataFrame:
    """The events of records with drafts, in the order of each file.

    parsed: run_id, line_no, byte_offset, rid (key of a record that only its first
    occurrence keeps, or null), ts, sid, sid_start (sid comes from a header), project
    (null where the record sets none), drafts. session: "latch" keeps the first sid of a
    file, "follow" takes the latest, "start" the latest header's and else the first.
    project_first: the first project stays. gaps: numbers are given before repeats go.
    """
    so_far = W.partitionBy("run_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    first, latest = F.first("sid", ignorenulls=True).over(so_far), F.last("sid", ignorenulls=True).over(so_far)
    header = F.last(F.when(F.col("sid_start"), F.col("sid")), ignorenulls=True).over(so_far)
    sid = {"latch": first, "follow": latest, "start": F.coalesce(header, first)}[session]
    held = (F.first if project_first else F.last)("project", ignorenulls=True).over(so_far)
    default = project(F.lit("."), F.lit(None))
    known = parsed.withColumns({"session_id": F.coalesce(sid, F.lit("unknown")), "project": F.coalesce(held, default)})
    place = F.row_number().over(W.partitionBy("run_id", "rid").orderBy("line_no"))
    known = known.withColumn("n_", place).where("rid IS NULL OR n_ = 1")
    events = known.select("run_id", "line_no", "byte_offset", "ts", "session_id", "project", F.posexplode("drafts").alias("ord", "d"))
    number = F.row_number().over(W.partitionBy("run_id").orderBy("line_no", "ord")) - 1
    again = F.row_number().over(W.partitionBy("run_id", "d.once").orderBy("line_no", "ord"))
    if gaps:
        events = events.withColumn("seq", number)
    events = events.withColumn("n_", again).where("d.once IS NULL OR n_ = 1")
    if not gaps:
        events = events.withColumn("seq", number)
    payload = [f"d.{k}" for k in FIELDS if k not in ("kind", "event_id", "once", "parent_id", "own_ts")]
    return events.select(
        F.lit(SCHEMA_VERSION).cast("smallint").alias("schema_version"), F.lit(tool).alias("source"), "run_id", "session_id", F.col("seq").cast("bigint").alias("seq"), "d.event_id", "d.parent_id",
        F.coalesce("d.own_ts", "ts").alias("ts"), "project", "d.kind", *payload, F.struct(F.col("run_id").alias("file"), "byte_offset", "line_no").alias("provenance"),
    )


def missing_places(events: DataFrame) -> DataFrame:
    """Events whose number doesn't grow along their file: run_id, seq, before."""
    w = W.partitionBy("run_id").orderBy("provenance.line_no", "seq")
    return events.withColumn("before", F.lag("seq").over(w)).where("before >= seq").select("run_id", "seq", "before")


def repeated_ids(events: DataFrame) -> DataFrame:
    """Ids of one session that several known events have: run_id, session_id, event_id, n."""
    return events.where("kind <> 'unknown'").groupBy("run_id", "session_id", "event_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def input_records(raw: DataFrame) -> DataFrame:
    """run_id, n: the records of each file that aren't blank, which no tool may have more than events."""
    return raw.groupBy("run_id").agg(F.count_if(T.trim(F.col("line")) != "").alias("n"))


def stub(raw: DataFrame, tool: str = "unknown") -> DataFrame:
    """One unknown event for each record that isn't blank."""
    r = records(raw)
    return finish(r.select("run_id", "line_no", "byte_offset", F.lit(None).cast("string").alias("rid"), time_of(F.col("j"), *UNKNOWN_TIMES).alias("ts"), F.lit(None).cast("string").alias("sid"), F.lit(False).alias("sid_start"), F.lit(None).cast(PROJECT).alias("project"), F.array(unknown_record()).cast(DRAFTS).alias("drafts")), tool)
