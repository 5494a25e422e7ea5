"""Decisions, sentences, polarity and options against plain Python on phrases and random mixes of them."""

import random

import plain
import pytest
from pyspark.sql import functions as F

from turnstone.functions import decide as D
from turnstone.functions import text as T
from turnstone.operators import nodes as N
from turnstone.operators import transcript as O
from turnstone.plans.phrases import EXPECTED, JUDGED, PHRASES


def mixes(n=150):
    rng = random.Random(11)
    glue = (" ", ". ", "\n", "? ", "! ", ".\n\n", ", ", " and ", "; ", ' "quoted" ', " (aside) ", " from A1 to B2 ", " replace X1 with Y2 ", " rather than ", " never use ", "It ", "but this ")
    words = " ".join(PHRASES).split()
    out = list(PHRASES)
    for _ in range(n):
        parts = [rng.choice(PHRASES) if rng.random() < 0.5 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 3))]
        out.append("".join(p + rng.choice(glue) for p in parts).strip())
    return out


TEXTS = mixes()


@pytest.fixture(scope="module")
def turns(spark):
    rows = [("f", "s" if i % 2 else "t", i, "user_turn" if i % 3 else "assistant_turn", t, None if i % 6 else "m1") for i, t in enumerate(TEXTS)] + [("f", "s", len(TEXTS), "file_edit", None, None)]
    return spark.createDataFrame(rows, "run_id string, session_id string, seq long, kind string, text string, model string").withColumns({
        "ts": F.timestamp_seconds("seq"), "event_id": F.col("seq").cast("string"), "path": F.lit("p"), "call_id": F.lit(None).cast("string"), "ok": F.lit(None).cast("boolean"),
        "to_event": F.lit(None).cast("string"), "first": F.lit(None).cast("long"), "last": F.lit(None).cast("long"),
    })


def test_expected_tables_are_what_plain_python_says():
    for t, e, j in zip(PHRASES, EXPECTED, JUDGED, strict=True):
        n, epitome, options, ban, with_edit, without = plain.decision(t)
        assert e == (plain.prose(t), n, epitome, ",".join(("+" if c else "-") + x for x, c in options), ban, with_edit, without)
        assert j[0] == plain.committal(t) and j[1] == plain.polarity(t)[0] and j[3] == plain.act(t)


def test_decisions_equal_plain_python(turns):
    got = {r.seq: r for r in O.decisions(turns).collect()}
    seen = 0
    for i, t in enumerate(TEXTS):
        n, epitome, options, ban, with_edit, without = plain.decision(t)
        score = with_edit if i % 2 else without
        if epitome is None or score < 0.45:
            assert i not in got, (t, got.get(i))
            continue
        seen += 1
        r = got[i]
        assert (r.epitome, r.is_ban, r.n_markers, round(r.score, 4)) == (epitome, ban, n, score), t
        assert [(o.text, o.chosen) for o in r.options] == options, t
        assert r.decided_by == (None if i % 3 else "assistant" if i % 6 else "m1")
    assert seen > 60 and len(got) == seen


def test_prose_markers_and_polarity_equal_plain_python(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    c = F.col("t")
    for r in df.select("t", T.clean_prose(c).alias("prose"), T.markers(c).alias("ms"), D.polarity(c).alias("p"), D.parse_options(c).alias("o"), D.is_committal(c).alias("committal"), T.languageness(c).alias("like")).collect():
        assert r.prose == plain.prose(r.t), r.t
        assert [(m.rule_id, m.matched_text, m.offset, m.place) for m in r.ms] == [(m[0], *m[3:]) for m in plain.markers(r.t)], r.t
        ban, options = plain.polarity(r.t)
        assert (r.p.is_ban, [(o.text, o.chosen) for o in r.p.options]) == (ban, options), r.t
        assert [(o.text, o.chosen) for o in r.o] == plain.options(r.t), r.t
        assert r.committal == plain.committal(r.t), r.t
        assert abs(r.like - plain.languageness(r.t)) < 1e-6


def test_antecedents_and_lists(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    text = F.lit("We moved to Redis 7. It is fast!\n\nIt must use TLS now.")
    pieces = D.sentences(text)
    assert one(pieces) == ["We moved to Redis 7.", " It is fast!", "\n", "\n", "It must use TLS now."]
    assert one(D.epitome_with_antecedent(pieces, F.lit(4))) == "It must use TLS now."
    assert one(D.epitome_with_antecedent(pieces, F.lit(1))) == "We moved to Redis 7. It is fast!"
    assert one(D.split_coordinated(F.lit("use A instead of B, drop C + add D and keep E."))) == ["use A instead of B", "drop C", "add D", "keep E"]
    assert one(D.split_coordinated(F.lit("add client, server"))) == ["add client, server"]
    assert one(D.split_coordinated(F.lit("use {a, b}, drop c"))) == ["use {a, b}, drop c"]
    assert one(T.markers(F.lit("x qq y"), T.gate([("own.q", "memory", "q+"), ("own.y", "ban", "soft", "y")])))[1].tier == "soft"
    with pytest.raises(ValueError, match="unknown category"):
        T.gate([("a", "nothing", "x")])


def test_times_that_are_none(spark):
    texts = ["2024", "170000", "2024-01", "2024-01-01", "12:30", "2024-01-01T00:00:00Z", "2024-01-01 00:00:00+01:00", " 10000000001 ", "-5", "1" * 19, "1e9", "", "2024-13-01T00:00:00Z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", F.unix_micros(T.parse_ts(F.col("t"))).alias("x")).collect()}
    assert [got[i] for i in range(len(texts))] == [2024_000_000, 170_000_000_000, None, None, None, 1704067200_000_000, 1704063600_000_000, 10000000001_000, -5_000_000, None, None, None, None]


def test_supersedes_equal_brute_force(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for run in range(3):
        n, events = 120, []
        for i in range(n):
            kind = rng.choice(["user_turn"] * 6 + ["rewind", "compaction"])
            a = rng.randrange(n)
            events.append((f"f{run}", "s", i, kind, f"e{i}", f"e{rng.randrange(n)}" if kind == "rewind" else None, a if kind == "compaction" else None, a + rng.randrange(-3, 40) if kind == "compaction" else None))
        for _, _, i, kind, _, to, first, last in events:
            covered = range(int(to[1:]) + 1, i + 1) if kind == "rewind" and int(to[1:]) < i else range(first, min(last, n)) if kind == "compaction" else ()
            for j in covered:
                want[f"f{run}", j] = f"rewind:s:{i}" if kind == "rewind" else f"compaction:s:{first}-{last}"
        rows += events
    df = spark.createDataFrame(rows, "run_id string, session_id string, seq long, kind string, event_id string, to_event string, first long, last long")
    assert {(r.run_id, r.seq): r.superseded_by for r in O.supersedes(df).collect()} == want and want


def test_nodes_json_redaction_and_keys(spark, turns):
    import json

    secret = spark.createDataFrame([("f", "s", 900, "user_turn", "let's use token = abcdef123 instead of Vault", "x")], "run_id string, session_id string, seq long, kind string, text string, model string")
    events = turns.unionByName(secret, allowMissingColumns=True).withColumn("ts", F.coalesce("ts", F.timestamp_millis(F.lit(1500))))
    prepared = N.prepare(events).cache()
    rows = prepared.collect()
    bodies = [json.loads(r.json) for r in rows]
    assert {b["node"] for b in bodies} == {"conversation", "decision", "episode", "binding"}
    own = next(b for b, r in zip(bodies, rows) if r.seq == 900 and r.node == "decision")
    assert "abcdef123" not in json.dumps(own) and "[REDACTED:assignment_secret]" in own["epitome"] and "decided_by" not in own and own["timestamp"] == "1970-01-01T00:00:01.5Z" and own["superseded_by"] is None
    assert any("decided_by" in b for b in bodies if b["node"] == "decision")
    assert spark.range(1).select(T.redact(F.lit("x"), content=False)).first()[0] == "[content elided]"
    keyed = N.keyed_rows(prepared).collect()
    assert len({r.pk for r in keyed}) == len(keyed) == len({r.pk for r in rows}) and {r.fact_status for r in keyed} <= set(N.CAMEL.values())
    shape = N.shape(prepared).first()
    assert shape.conversations == sum(b["node"] == "conversation" for b in bodies) and shape.bans == sum(bool(b.get("is_ban")) for b in bodies)
