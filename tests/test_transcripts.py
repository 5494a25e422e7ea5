"""Operators on small hand-made transcripts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from turnstone.functions import text as T
from turnstone.operators import nodes as N
from turnstone.operators import transcript as O
from turnstone.sources.lines import split_lines
from turnstone.streaming.watch import watch

EVENT = "run_id string, session_id string, seq long, event_id string, kind string, ts timestamp, text string, path string, call_id string, ok boolean, to_event string, first long, last long"


def event(seq, kind, at=None, **more):
    base = dict.fromkeys(("text", "path", "call_id", "ok", "to_event", "first", "last"))
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    return {"run_id": "f", "session_id": "s", "seq": seq, "event_id": f"e{seq}", "kind": kind, "ts": start + dt.timedelta(seconds=seq * 10 if at is None else at)} | base | more


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], EVENT)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_markers_in_rule_order_with_byte_offsets(spark):
    found = one(spark, T.markers(F.lit("é😀 use X instead of Y")))
    assert [m.rule_id for m in found] == ["decision_verb.use", "rejection.instead_of"]
    assert [(m.matched_text, m.offset) for m in found] == [("use", 7), ("instead of", 13)]


@pytest.mark.parametrize("text, tier", [("ship it", "none"), ("always lint", "soft"), ("adopt it", "strong")])
def test_strongest_tier(spark, text, tier):
    assert one(spark, T.strongest_tier(T.markers(F.lit(text)))) == tier


def test_single_precision_tier_boundary(spark):
    # .60 + .20 + .05 in single precision is just .85
    m = T.markers(F.lit("use Postgres"))
    score = T.seed_score(m, F.lit(False), F.lit(False), F.lit(False))
    assert one(spark, T.tier_for(score)) in ("observed", "deterministically_derived")
    assert one(spark, T.tier_for(F.lit(0.449).cast("float"))) is None


def test_prose(spark):
    assert one(spark, T.clean_prose(F.lit("keep this good line\nerror: nope\nsrc/a/b.rs"))) == "keep this good line"
    assert one(spark, T.clean_prose(F.lit("too few"))) is None
    assert one(spark, T.clean_prose(F.lit(None).cast("string"))) is None


def test_redaction_order(spark):
    assert one(spark, T.redact(F.lit("token = abcdef123 AKIA" + "A" * 16))) == "[REDACTED:assignment_secret] [REDACTED:aws_access_key]"


def test_timestamps(spark):
    got = [one(spark, F.unix_micros(T.parse_ts(F.lit(x)))) for x in ("2024-01-01T00:00:00.12Z", "10", "10000000001", "bad")]
    assert got == [1704067200120000, 10_000_000, 10000000001000, None]


def test_lines(spark):
    df = spark.createDataFrame([(1, "é\n\nb\n"), (2, ""), (3, None)], "k int, t string")
    got = [(r.k, r.line_no, r.byte_offset, r.line) for r in split_lines(df, ["k"], F.col("t")).orderBy("k", "line_no").collect()]
    assert got == [(1, 1, 0, "é"), (1, 2, 3, ""), (1, 3, 4, "b")]


def test_failed_calls_make_no_episode(spark):
    rows = [event(0, "file_edit", path="a", call_id="1"), event(1, "tool_result", call_id="1", ok=True), event(2, "tool_result", call_id="1", ok=False), event(3, "file_edit", path="b"), event(4, "file_edit", path="c", call_id="2")]
    assert sorted(r.path for r in O.episodes(frame(spark, rows)).collect()) == ["b", "c"]


def test_rewind_and_compaction(spark):
    rows = [event(i, "user_turn", text="x") for i in range(6)] + [event(6, "rewind", to_event="e3"), event(7, "compaction", first=0, last=2), event(8, "rewind", to_event="none")]
    got = {r.seq: r.superseded_by for r in O.supersedes(frame(spark, rows)).collect()}
    assert got == {4: "rewind:s:6", 5: "rewind:s:6", 6: "rewind:s:6", 0: "compaction:s:0-2", 1: "compaction:s:0-2"}


def test_bindings_match_brute_force(spark):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    times = [0, 1, 1800, 1800.9, 1801, 3000, 3000, 4799.9]
    d = [("f", f"s{rng.randint(0, 1)}", start + dt.timedelta(seconds=rng.choice(times)), i, f"d{i}", "x" if rng.random() < 0.2 else None) for i in range(12)]
    e = [("f", f"s{rng.randint(0, 1)}", start + dt.timedelta(seconds=rng.choice(times)), 100 + i, f"e{i}", f"p{i % 3}") for i in range(40)]
    expected = {}
    for x in e:
        fit = [y for y in d if y[1] == x[1] and y[5] is None and y[2] <= x[2] and int((x[2] - y[2]).total_seconds()) <= 1800]
        if fit:
            expected[x[4]] = max(fit, key=lambda y: (y[2], y[3]))[4]
    decided = spark.createDataFrame(d, "run_id string, session_id string, ts timestamp, seq long, decision_id string, superseded_by string")
    found = spark.createDataFrame(e, "run_id string, session_id string, ts timestamp, seq long, episode_id string, path string")
    bound = O.bindings(found, decided)
    assert {r.episode_id: r.decision_id for r in bound.collect()} == expected
    stats = O.correlations(bound).collect()
    assert len(stats) == len(expected) and all(0 <= r.p <= 1 for r in stats if r.p is not None)


def test_empty_tables(spark):
    ev = spark.createDataFrame([], EVENT)
    found, decided = O.episodes(ev), O.decisions(ev)
    assert N.nodes(decided, found, O.bindings(found, decided)).count() == 0


def test_numbering_dedup_and_stickiness(spark):
    df = spark.createDataFrame([("f", 1, 0, "a", "turn", "p"), ("f", 2, 0, "a", "turn", None), ("f", 3, 0, "u", "unknown", None), ("f", 4, 0, "u", "unknown", None)], "run_id string, line_no int, ord int, event_id string, kind string, project string")
    got = O.sticky(O.number(O.first_seen(df)), "project", ".").orderBy("seq").collect()
    assert [(r.seq, r.event_id, r.project) for r in got] == [(0, "a", "p"), (1, "u", "p"), (2, "u", "p")]


def test_source_names(spark):
    assert [one(spark, T.parse_source(F.lit(x))) for x in ("Claude", " vs-code ", "nope")] == ["claude_code", "vscode", None]
    assert [one(spark, T.infer_source(F.lit(x))) for x in ("/h/.codex/a", "/x/Code/b", "a.ndjson", "b")] == ["codex", "vscode", "otel", None]


def test_watch_drains_what_is_there(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"x": 1}\n{"x": 2}\n')
    seen = []
    watch(spark, str(tmp_path / "in"), "x int", str(tmp_path / "check"), lambda df, i: seen.append(df.count()), once=True).awaitTermination()
    assert seen == [2]
