"""Events to nodes: gated turns, decisions, episodes, superseded turns, bindings, statistics, order.

Events have run_id (a file), session_id, seq, event_id, kind, ts and, by kind, text,
model, path, call_id, ok, to_event, first and last. Each operator shuffles on the key
it needs and no more; all windows are within a run and session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import decide as D
from ..functions import lexicon as L
from ..functions import text as T
from ..functions.rules import MAX_GAP_SECONDS, MIN_ARCS, RULES

LAST = 9223372036854775807
#: Levels of the tree of ranges of seq; 2^LEVELS is beyond any.
LEVELS = 40
KEY = ["run_id", "session_id"]


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are evaluated here, once: filters and projections that follow don't repeat them."""
    keep = [c for c in df.columns if c not in columns]
    return df.select(*keep, F.explode_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("now_")).select(*keep, *[f"now_.{n}" for n in columns])


def number(records: DataFrame) -> DataFrame:
    """seq: the place of each record in its file, from 0, by (line_no, ord)."""
    return records.withColumn("seq", F.row_number().over(W.partitionBy("run_id").orderBy("line_no", "ord")) - 1)


def first_seen(events: DataFrame) -> DataFrame:
    """The first event of each id of a file; unknown events are all kept."""
    place = F.row_number().over(W.partitionBy("run_id", "event_id").orderBy("line_no", "ord"))
    return events.withColumn("_n", place).where((F.col("_n") == 1) | (F.col("kind") == "unknown")).drop("_n")


def sticky(events: DataFrame, column: str, default: str) -> DataFrame:
    """The last known value of a column carries on within the file."""
    w = W.partitionBy("run_id").orderBy("line_no", "ord").rowsBetween(W.unboundedPreceding, 0)
    return events.withColumn(column, F.coalesce(F.last(column, ignorenulls=True).over(w), F.lit(default)))


def failed_calls(events: DataFrame) -> DataFrame:
    """run_id, call_id of calls whose last result failed."""
    return events.where("kind = 'tool_result' AND call_id IS NOT NULL").groupBy("run_id", "call_id").agg(F.max_by("ok", "seq").alias("ok")).where("NOT ok").drop("ok")


def episodes(events: DataFrame) -> DataFrame:
    """File edits but those whose call's last result failed; edits without call id stay. Columns of the edit follow, where events have them."""
    edits = events.where("kind = 'file_edit'").join(failed_calls(events), ["run_id", "call_id"], "left_anti")
    more = [c for c in ("old", "new", "unified", "added", "removed") if c in events.columns]
    git = ["project.git"] if "project" in events.columns else []
    return edits.select("run_id", "session_id", "seq", "ts", "path", F.concat(F.lit("episode:"), F.sha2(F.concat_ws(":", "session_id", "seq", "path"), 256)).alias("episode_id"), *more, *git)


def edited_sessions(found: DataFrame) -> DataFrame:
    return found.select("run_id", "session_id").distinct()


def _cover(lo: Column, hi: Column) -> Column:
    """The nodes (level, number) of the binary tree over seq that make up lo to hi, at most two a level."""
    start = F.struct(lo.alias("l"), (hi + 1).alias("r"), F.array().cast("array<struct<level:int,number:bigint>>").alias("nodes"))

    def step(acc: Column, level: Column) -> Column:
        left, right = acc["l"], acc["r"]
        open_ = left < right
        take_left, take_right = open_ & (left % 2 == 1), open_ & (right % 2 == 1)
        node = lambda n: F.array(F.struct(level.alias("level"), n.cast("bigint").alias("number")))
        none = F.array().cast("array<struct<level:int,number:bigint>>")
        nodes = F.concat(acc["nodes"], F.when(take_left, node(left)).otherwise(none), F.when(take_right, node(right - 1)).otherwise(none))
        return F.struct(F.shiftright(left + take_left.cast("int"), 1).alias("l"), F.shiftright(right - take_right.cast("int"), 1).alias("r"), nodes.alias("nodes"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), start, step, lambda acc: acc["nodes"])


def supersede_marks(events: DataFrame) -> DataFrame:
    """run_id, session_id, at, lo, hi, marker: the range of seq that each rewind or compaction takes back.

    A rewind to event e covers seq in (seq of e, own seq]; a compaction [first, last).
    Unknown targets and those not before the rewind cover nothing.
    """
    rewinds = events.where("kind = 'rewind'").select(*KEY, "seq", "to_event")
    targets = events.join(rewinds.select(*KEY).distinct(), KEY, "left_semi").groupBy(*KEY, F.col("event_id").alias("to_event")).agg(F.min("seq").alias("target"))
    back = rewinds.join(targets, [*KEY, "to_event"]).where("target < seq").select(*KEY, F.col("seq").alias("at"), (F.col("target") + 1).alias("lo"), F.col("seq").alias("hi"), F.concat_ws(":", F.lit("rewind"), "session_id", "seq").alias("marker"))
    packed = events.where("kind = 'compaction' AND first < last").select(*KEY, F.col("seq").alias("at"), F.col("first").alias("lo"), (F.col("last") - 1).alias("hi"), F.concat(F.lit("compaction:"), F.col("session_id"), F.lit(":"), F.col("first"), F.lit("-"), F.col("last")).alias("marker"))
    return back.unionByName(packed)


def supersedes(events: DataFrame) -> DataFrame:
    """run_id, session_id, seq, superseded_by: the last rewind or compaction that covers an event.

    Ranges become nodes of a binary tree over seq, of which each keeps its last marker;
    an event looks up the nodes above it. So n events and m ranges make about
    n log n rows, however many ranges cover an event, and all joins are on equal keys.
    """
    marks = supersede_marks(events).where("hi >= 0").withColumn("lo", F.greatest(F.lit(0), "lo"))
    nodes = marks.select(*KEY, "at", "marker", F.explode(_cover(F.col("lo").cast("bigint"), F.col("hi").cast("bigint"))).alias("n"))
    last = nodes.groupBy(*KEY, "n.level", "n.number").agg(F.max(F.struct("at", "marker")).alias("m"))
    levels = last.groupBy(*KEY).agg(F.collect_set("level").alias("levels"))  # at most LEVELS
    above = events.select(*KEY, "seq").join(levels, KEY).select(*KEY, "seq", F.explode("levels").alias("level"))
    above = above.withColumn("number", F.expr("shiftright(cast(seq AS bigint), level)"))
    return above.join(last, [*KEY, "level", "number"]).groupBy(*KEY, "seq").agg(F.max("m")["marker"].alias("superseded_by"))


def gated_turns(events: DataFrame, table=RULES, clean: bool = True, extra: tuple[str, ...] = ()) -> DataFrame:
    """Turns with markers: keys, ts, assistant, decided_by, prose, markers.

    Each step is evaluated once and only on what the step before it left.
    """
    turns = events.where("kind IN ('user_turn', 'assistant_turn') AND text IS NOT NULL")
    model = F.col("model") if "model" in events.columns else F.lit(None).cast("string")
    assistant = F.col("kind") == "assistant_turn"
    turns = turns.select(*KEY, "seq", "ts", assistant.alias("assistant"), F.when(assistant, F.coalesce(model, F.lit("assistant"))).alias("decided_by"), "text", *(["provenance"] if "provenance" in events.columns else []))
    prose = computed(turns, prose=T.clean_prose(F.col("text"), extra) if clean else F.col("text")).drop("text").where("prose IS NOT NULL")
    found = computed(prose, found=T.matches(F.col("prose"), table)).where(F.exists("found", lambda m: m != ""))
    placed = computed(found, before=T.before_matches(F.col("prose"), F.col("found"), table))
    return computed(placed, markers=T.markers_of(F.col("found"), F.col("before"), table)).drop("found", "before")


def conversations(gated: DataFrame) -> DataFrame:
    """One span for each gated turn of a user, whether or not it decides something."""
    return gated.where("NOT assistant").drop("assistant", "decided_by")


def candidates(gated: DataFrame) -> DataFrame:
    """Gated turns with a sentence that decides: epitome, options, is_ban and the terms of the score.

    The sentence of the best committal marker, with its antecedent; turns whose sentence
    refers to something that isn't there are left out.
    """
    pieces = computed(gated, pieces=D.sentences(F.col("prose")))
    spots = computed(pieces, spots=F.transform("markers", lambda m, i: F.struct(i.alias("i"), m["category"].alias("category"), D.sentence_at(F.col("pieces"), m["place"]).alias("k"))))
    fit = F.filter(F.array_distinct(F.transform("spots", lambda s: s["k"])), lambda k: D.is_committal(D.epitome(F.col("pieces"), k)))
    fits = computed(spots, fit=fit).where(F.size("fit") > 0)
    rank = F.create_map(*[F.lit(x) for kv in L.ANCHOR.items() for x in kv])
    best = F.array_min(F.transform(F.filter("spots", lambda s: F.array_contains("fit", s["k"])), lambda s: F.struct(F.element_at(rank, s["category"]).alias("p"), s["i"].alias("i"), s["k"].alias("k"))))
    anchored = computed(fits, k=best["k"]).drop("spots", "fit")
    said = computed(anchored, base=D.epitome(F.col("pieces"), F.col("k")), epitome=D.epitome_with_antecedent(F.col("pieces"), F.col("k")))
    said = said.where(~(D.opens_with_unbound_subject(F.col("base")) & ~D.antecedent_resolved(F.col("epitome"))))
    judged = computed(said, polarity=D.polarity(F.col("epitome")), terms=D.score_terms(F.col("epitome")), options=D.parse_options(F.col("prose")))
    return judged.withColumn("is_ban", F.col("polarity.is_ban")).drop("pieces", "k", "base", "polarity")


def decisions(events: DataFrame, gated: DataFrame | None = None, clean: bool = True) -> DataFrame:
    """Decisions with their full score and its tier, the options, the author and what superseded them."""
    found = candidates(gated_turns(events, clean=clean) if gated is None else gated)
    edited = edited_sessions(episodes(events)).withColumn("edited", F.lit(True))
    scored = found.join(edited, KEY, "left").withColumn("edited", F.coalesce("edited", F.lit(False)))
    scored = computed(scored, score=D.score(F.col("terms"), T._strength(F.col("markers")), T.category_bonus(F.col("markers")), F.col("is_ban"), F.col("edited")))
    scored = computed(scored, fact_status=T.tier_for(F.col("score"))).where("fact_status IS NOT NULL")
    scored = scored.join(supersedes(events), [*KEY, "seq"], "left")
    return scored.select(*KEY, "seq", "ts", "epitome", "options", "is_ban", "score", "fact_status", "superseded_by", "decided_by", F.size("markers").alias("n_markers"), F.concat_ws(":", F.lit("decision"), "session_id", "seq").alias("decision_id"))


def bindings(found: DataFrame, decided: DataFrame) -> DataFrame:
    """Each episode with the latest decision of its session that isn't superseded, isn't later and isn't over half an hour old.

    One sort of decisions and episodes together: at equal times decisions stand
    first, and the last one seen is the one that binds.
    """
    d = decided.where("superseded_by IS NULL").select(*KEY, "ts", F.lit(0).alias("late"), "seq", "decision_id", F.lit(None).cast("string").alias("episode_id"), F.lit(None).cast("string").alias("path"))
    e = found.select(*KEY, "ts", F.lit(1).alias("late"), "seq", F.lit(None).cast("string").alias("decision_id"), "episode_id", "path")
    w = W.partitionBy(*KEY).orderBy("ts", "late", "seq").rowsBetween(W.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("late") == 0, F.struct("decision_id", F.col("ts").alias("t_use"))), ignorenulls=True).over(w)
    bound = d.unionByName(e).withColumn("by", seen).where("late = 1 AND by IS NOT NULL")
    gap = F.unix_micros("ts") - F.unix_micros("by.t_use")
    return bound.where(gap < (MAX_GAP_SECONDS + 1) * 1_000_000).select(*KEY, "by.decision_id", "episode_id", "path", "by.t_use", F.col("ts").alias("t_gen"))


def temporally_valid(t_use: Column, t_gen: Column) -> Column:
    return t_use <= t_gen


def correlations(arcs: DataFrame) -> DataFrame:
    """support, confidence, lift, phi and p of each arc, from counts by decision, path and run; null under MIN_ARCS.

    Counts are aggregates joined back, not windows over a run, so a run may be of any size.
    """
    cell = arcs.groupBy("run_id", "decision_id", "path").agg(F.count(F.lit(1)).alias("n11"))
    row = cell.groupBy("run_id", "decision_id").agg(F.sum("n11").alias("row1"))
    col = cell.groupBy("run_id", "path").agg(F.sum("n11").alias("col1"))
    all_ = row.groupBy("run_id").agg(F.sum("row1").alias("n"))
    t = cell.join(row, ["run_id", "decision_id"]).join(col, ["run_id", "path"]).join(all_, "run_id")
    n11, row1, col1, n = (F.col(c).cast("double") for c in ("n11", "row1", "col1", "n"))
    confidence, share = n11 / row1, col1 / n
    n00 = n - row1 - col1 + n11
    denom = F.sqrt(row1 * (n - row1) * col1 * (n - col1))
    phi = F.when(denom == 0, 0.0).otherwise((n11 * n00 - (row1 - n11) * (col1 - n11)) / denom)
    stats = {"support": n11 / n, "confidence": confidence, "lift": confidence / share, "phi": phi, "p": T.erfc(F.sqrt(n * phi * phi / 2.0))}
    enough = F.col("row1") >= MIN_ARCS
    t = t.select("run_id", "decision_id", "path", *[F.when(enough, T.round6(v)).alias(k) for k, v in stats.items()])
    return arcs.join(t, ["run_id", "decision_id", "path"])
