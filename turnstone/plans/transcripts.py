"""Queries over transcripts made from the events table, and over real text, each with DuckDB SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decide as D
from ..functions import rules as R
from ..functions import text as T
from ..operators import nodes as N
from ..operators import transcript as O
from ..sources.lines import split_lines
from .phrases import EXPECTED, JUDGED, PHRASES

def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as transcripts: a user is a session and a file; time runs 97 seconds an event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    e = e.select(F.concat(F.lit("u"), F.col("user_id")).alias("run_id"), F.col("ts").alias("line_no"), F.col("event_id").alias("ord"), "event_type", "k")
    e = O.number(e)
    kind = (
        F.when(F.col("event_type") == "signup", "user_turn").when(F.col("event_type") == "view", "assistant_turn").when(F.col("event_type") == "click", "file_edit")
        .when(F.col("event_type") == "error", "tool_result").when(F.col("k") % 10 == 0, "rewind").when(F.col("k") % 10 == 5, "compaction").otherwise("user_turn")
    )
    e = e.withColumn("kind", kind)
    turn = F.col("kind").isin("user_turn", "assistant_turn")
    call = F.concat(F.lit("c"), F.col("k") % 40)
    return e.select(
        "run_id", F.col("run_id").alias("session_id"), "seq", F.concat(F.lit("e"), F.col("seq")).alias("event_id"), "kind",
        F.timestamp_seconds(F.lit(1704067200) + F.col("seq") * 97).alias("ts"),
        F.when(turn, F.element_at(F.array(*[F.lit(x) for x in PHRASES]), F.col("k") % len(PHRASES) + 1)).alias("text"),
        F.when(F.col("kind") == "file_edit", F.concat(F.lit("src/mod_"), F.col("k") % 7, F.lit(".rs"))).alias("path"),
        F.when(F.col("kind").isin("file_edit", "tool_result") & (F.col("k") % 11 != 0), call).alias("call_id"),
        F.when(F.col("kind") == "tool_result", F.col("k") % 3 != 0).alias("ok"),
        F.when(F.col("kind") == "rewind", F.concat(F.lit("e"), F.col("seq") - 6)).alias("to_event"),
        F.when(F.col("kind") == "compaction", F.greatest(F.lit(0), F.col("seq") - 9)).alias("first"),
        F.when(F.col("kind") == "compaction", F.col("seq") - 2).alias("last"),
    )


def _nodes(spark, sf_dir):
    ev = transcripts(spark, sf_dir)
    gated = O.gated_turns(ev)
    found, decided = O.episodes(ev), O.decisions(ev, gated)
    return gated, found, decided, O.bindings(found, decided)


def _options(options):
    return F.array_join(F.transform(options, lambda o: F.concat(F.when(o["chosen"], "+").otherwise("-"), o["text"])), ",")


def event_kinds(spark, sf_dir):
    return transcripts(spark, sf_dir).groupBy("run_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def gate_markers(spark, sf_dir):
    t = transcripts(spark, sf_dir).where("text IS NOT NULL").select("run_id", "seq", F.posexplode(T.markers(F.col("text"))).alias("i", "m"))
    return t.select("run_id", "seq", F.col("i").cast("bigint").alias("i"), "m.rule_id", "m.category", "m.tier", "m.matched_text", "m.offset")


def conversation_nodes(spark, sf_dir):
    return O.conversations(O.gated_turns(transcripts(spark, sf_dir))).select("run_id", "seq", "prose", F.size("markers").alias("n_markers"))


def episode_nodes(spark, sf_dir):
    return O.episodes(transcripts(spark, sf_dir)).select("run_id", "seq", "path", "episode_id")


def edited_sessions(spark, sf_dir):
    return O.edited_sessions(O.episodes(transcripts(spark, sf_dir)))


def superseded_turns(spark, sf_dir):
    return O.supersedes(transcripts(spark, sf_dir)).select("run_id", "seq", "superseded_by")


def decision_nodes(spark, sf_dir):
    d = O.decisions(transcripts(spark, sf_dir))
    return d.select("run_id", "seq", "epitome", _options(F.col("options")).alias("options"), "is_ban", F.round(F.col("score").cast("double"), 4).alias("score"), "fact_status", "superseded_by", "decided_by", "n_markers")


def binding_edges(spark, sf_dir):
    b = _nodes(spark, sf_dir)[3]
    return b.select("run_id", "decision_id", "episode_id", "path", F.unix_seconds("t_use").alias("t_use"), F.unix_seconds("t_gen").alias("t_gen"))


def binding_statistics(spark, sf_dir):
    c = O.correlations(_nodes(spark, sf_dir)[3])
    return c.select("decision_id", "episode_id", "support", "confidence", "lift", "phi", F.round("p", 4).alias("p"))


def _every(spark, sf_dir):
    gated, found, decided, bound = _nodes(spark, sf_dir)
    return N.nodes(decided, found, bound, O.conversations(gated))


def node_counts(spark, sf_dir):
    return N.counts(_every(spark, sf_dir))


def node_order(spark, sf_dir):
    """Each node's place in the order of its file."""
    return _every(spark, sf_dir).select("run_id", "seq", "rank", "secondary", "node")


def node_rows(spark, sf_dir):
    """Rows of a keyed store: the key, the kind and the status."""
    return N.keyed_rows(_every(spark, sf_dir)).select("pk", "node_type", "fact_status", F.get_json_object("json", "$.epitome").alias("epitome"), F.get_json_object("json", "$.prov.t_gen").alias("t_gen"))


def node_records(spark, sf_dir):
    """Bi-temporal records of bindings and how many records of each kind and time there are."""
    r = N.records(_every(spark, sf_dir), dt.datetime(2024, 6, 1, tzinfo=dt.timezone.utc))
    return r.groupBy("kind", F.unix_seconds("valid_at").alias("valid_at"), F.unix_seconds("transaction_at").alias("transaction_at")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("properties")).alias("n_properties"), F.count("episode_id").alias("n_episodes"))


def file_shapes(spark, sf_dir):
    shape = N.shape(_every(spark, sf_dir))
    return shape.select("run_id", "conversations", "decisions", "episodes", "bindings", "bans", F.array_join("options", ",").alias("options"))


def phrase_judgements(spark, sf_dir):
    """What the text of each turn is, sentence rules apart: intent, polarity, act, choice, mechanism, subject, language."""
    t = transcripts(spark, sf_dir).where("text IS NOT NULL").select("text").distinct()
    t = t.select("text", T.once(D.polarity(F.col("text")), lambda p: F.struct(p["is_ban"].alias("is_ban"), _options(p["options"]).alias("options"))).alias("p"), T.ascii_lower(F.col("text")).alias("low"))
    x = F.col("text")
    return t.select(
        "text", D.is_committal(x).alias("committal"), "p.is_ban", F.col("p.options").alias("polar_options"), D.is_decisional_act(x).alias("act"), D.has_resolved_choice(x, F.col("low")).alias("choice"),
        D.has_named_mechanism(x, F.col("low")).alias("mechanism"), D.opens_with_unbound_subject(x).alias("unbound"), D.antecedent_resolved(x).alias("resolved"), F.round(T.languageness(x).cast("double"), 4).alias("languageness"),
        T.admits(x).alias("admits"), T.seeds_decision(T.markers(x), F.lit(False)).alias("seeds"), T.strongest_tier(T.markers(x)).alias("tier"),
    )


def read_times(spark, sf_dir):
    """Times written in several ways, wrong ones among them."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts")
    e = e.withColumn("ts", F.col("ts").cast("timestamp"))
    sec, way = F.unix_seconds("ts"), F.col("event_id") % 10
    text = (
        F.when(way == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(way == 1, sec.cast("string")).when(way == 2, (sec * 1000 + 7).cast("string")).when(way == 3, F.date_format("ts", "yyyy-MM-dd"))
        .when(way == 4, F.date_format("ts", "HH:mm")).when(way == 5, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'+01:30'")).when(way == 6, F.lit("not a time")).when(way == 7, F.date_format("ts", "yyyy"))
        .when(way == 8, F.concat(F.lit(" "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss'-02:00'"), F.lit(" "))).otherwise(F.lit(None).cast("string"))
    )
    return e.select("event_id", F.unix_micros(T.parse_ts(text)).alias("micros"))


def document_lines(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    x = split_lines(d, ["doc_id"], F.col("text"))
    return x.select("doc_id", "line_no", "byte_offset", F.octet_length("line").cast("bigint").alias("n_bytes"))


def prose_lines(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.coalesce(F.md5(T.clean_prose(F.col("text")).cast("binary")), F.lit("-")).alias("prose_md5"))


def turn_words(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.sum(T.alpha_word_count(F.col("text"))).alias("words"), F.count_if(T.is_question(F.col("text"))).alias("questions"), F.count_if(T.is_shouting(F.col("text"))).alias("shouts"))


def language_like(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # The texts themselves, spoiled forms of every third, and shouted ones of every fifth.
    spoiled = F.concat_ws("#=;", F.md5(F.col("text").cast("binary")), F.translate(F.substring("text", 1, 300), "aeiouyAEIOUY ", "#=;{}[]|0!"))
    x = F.when(F.col("doc_id") % 3 == 0, spoiled).when(F.col("doc_id") % 5 == 1, F.translate(F.substring("text", 1, 80), T._LOWER, T._UPPER)).otherwise(F.col("text"))
    d = d.select("lang", x.alias("x"))
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.count_if(T.is_garbage(F.col("x"))).alias("garbage"), F.count_if(T.looks_like_code_or_log(F.col("x"))).alias("code"), F.count_if(T.is_shouting(F.col("x"))).alias("shouts"))


def redacted_pages(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", T.contains_secret(F.col("html")).alias("secret"), F.md5(T.redact(F.col("html")).cast("binary")).alias("redacted_md5"), F.md5(T.decode_entities(F.col("html")).cast("binary")).alias("decoded_md5"))


def tools_of_urls(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    parts = F.array(*[F.lit(x) for x in _PLACES])
    path = F.concat(F.lit("/home/"), F.element_at(parts, (F.col("page_id") % len(_PLACES) + 1).cast("int")), F.regexp_replace("url", "^.*://", "/"), F.when(F.col("page_id") % 2 == 0, ".ndjson").otherwise(".jsonl"))
    return p.select("page_id", T.infer_source(path).alias("tool"), T.parse_source(F.element_at(parts, (F.col("page_id") % len(_PLACES) + 1).cast("int"))).alias("named"))


#: Folders and names of tools, some in other spelling, some of none.
_PLACES = (".codex", "Claude", "gemini", "Cursor", "windsurf", "zed", "copilot", "Hermes", "opencode", "vs-code", "Code", "otel", "nothing", "claude-code", "open-code", "unknown", "me")


# ---- the same in DuckDB ----


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_EVENTS = f"""
numbered AS (
  SELECT 'u' || user_id AS run_id, event_type, json_extract(props, '$.k')::INT AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events
), kinds AS (
  SELECT *, CASE WHEN event_type = 'signup' THEN 'user_turn' WHEN event_type = 'view' THEN 'assistant_turn' WHEN event_type = 'click' THEN 'file_edit'
    WHEN event_type = 'error' THEN 'tool_result' WHEN k % 10 = 0 THEN 'rewind' WHEN k % 10 = 5 THEN 'compaction' ELSE 'user_turn' END AS kind FROM numbered
), ev AS (
  SELECT run_id, seq, kind, 1704067200 + seq * 97 AS t,
    CASE WHEN kind IN ('user_turn', 'assistant_turn') THEN ([{', '.join(map(_q, PHRASES))}])[k % {len(PHRASES)} + 1] END AS text,
    CASE WHEN kind = 'file_edit' THEN 'src/mod_' || (k % 7) || '.rs' END AS path,
    CASE WHEN kind IN ('file_edit', 'tool_result') AND k % 11 <> 0 THEN 'c' || (k % 40) END AS call_id,
    CASE WHEN kind = 'tool_result' THEN k % 3 <> 0 END AS ok,
    CASE WHEN kind = 'rewind' THEN seq - 6 END AS target, greatest(0, seq - 9) AS first, seq - 2 AS last
  FROM kinds
)"""
_EPISODES = """
failed AS (SELECT run_id, call_id FROM ev WHERE kind = 'tool_result' AND call_id IS NOT NULL GROUP BY ALL HAVING NOT arg_max(ok, seq)),
ep AS (SELECT e.run_id, seq, t, path, 'episode:' || sha256(e.run_id || ':' || seq || ':' || path) AS episode_id FROM ev e WHERE kind = 'file_edit' AND NOT EXISTS (SELECT 1 FROM failed f WHERE f.run_id = e.run_id AND f.call_id = e.call_id))"""
_SUPERSEDED = """
marks AS (
  SELECT run_id, seq AS at_, target + 1 AS lo, seq AS hi, 'rewind:' || run_id || ':' || seq AS marker FROM ev WHERE kind = 'rewind' AND target >= 0
  UNION ALL SELECT run_id, seq, first, last - 1, 'compaction:' || run_id || ':' || first || '-' || last FROM ev WHERE kind = 'compaction'
), sup AS (SELECT e.run_id, e.seq, arg_max(marker, at_) AS superseded_by FROM ev e JOIN marks m ON e.run_id = m.run_id AND e.seq BETWEEN lo AND hi GROUP BY ALL)"""
_MARKERS = "[" + ", ".join(f"{{'rule_id': {_q(a)}, 'category': {_q(b)}, 'tier': {_q(c)}, 'matched_text': regexp_extract(text, {_q('(?i)' + d)}, 0), 'place': strlen(regexp_extract(text, {_q('(?is)^(.*?)(?:' + d + ')')}, 1))}}" for a, b, c, d in R.RULES) + "]"
_QUESTION = "(ends_with({0}, '?') OR " + " OR ".join(f"starts_with(lower({{0}}), {_q(x)})" for x in T.QUESTION_LEADS) + " OR " + " OR ".join(f"contains(lower({{0}}), {_q(x)})" for x in T.QUESTION_INSIDE) + ")"


def _value(x) -> str:
    return "NULL" if x is None else _q(x) if isinstance(x, str) else str(x).upper() if isinstance(x, bool) else repr(x)


_PHRASES = "phrases(text, prose, n_markers, epitome, options, is_ban, with_edit, without) AS (VALUES " + ", ".join("(" + ", ".join(map(_value, (t, *e))) + ")" for t, e in zip(PHRASES, EXPECTED, strict=True)) + ")"
_DECISIONS = f"""
{_PHRASES},
turns AS (SELECT run_id, seq, t, kind, prose, n_markers, epitome, options, is_ban, CASE WHEN run_id IN (SELECT run_id FROM ep) THEN with_edit ELSE without END AS score FROM ev JOIN phrases USING (text) WHERE n_markers > 0),
dec AS (
  SELECT s.run_id, s.seq, t, epitome, options, is_ban, score::DOUBLE AS score, n_markers, superseded_by, 'decision:' || s.run_id || ':' || s.seq AS decision_id, CASE WHEN kind = 'assistant_turn' THEN 'assistant' END AS decided_by,
    CASE WHEN score >= 0.85 THEN 'observed' WHEN score >= 0.65 THEN 'deterministically_derived' ELSE 'statistically_ranked' END AS fact_status
  FROM turns s LEFT JOIN sup USING (run_id, seq) WHERE epitome IS NOT NULL AND score >= 0.45
)"""
_BINDINGS = f"""
near_ AS (
  SELECT e.run_id, d.decision_id, e.episode_id, e.path, d.t AS t_use, e.t AS t_gen, row_number() OVER (PARTITION BY e.episode_id ORDER BY d.t DESC, d.seq DESC) AS r
  FROM ep e JOIN dec d ON e.run_id = d.run_id AND d.superseded_by IS NULL AND d.t <= e.t AND e.t - d.t <= {R.MAX_GAP_SECONDS}
), bind AS (SELECT run_id, decision_id, episode_id, path, t_use, t_gen FROM near_ WHERE r = 1)"""
_ALL = f"WITH {_EVENTS}, {_EPISODES}, {_SUPERSEDED}, {_DECISIONS}, {_BINDINGS}"
_EVERY = f"""{_ALL}, every AS (
  SELECT run_id, seq, 0 AS rank, run_id AS secondary, 'conversation' AS node, 'observed' AS fact_status, 'conversation:' || run_id || ':' || seq || '..' || (seq + 1) AS pk, NULL AS epitome, NULL::BIGINT AS t_gen, 6 AS props, '' AS options, FALSE AS ban FROM turns WHERE kind = 'user_turn'
  UNION ALL SELECT run_id, seq, 1, decision_id, 'decision', fact_status, 'decision:' || run_id || ':' || seq || '..' || (seq + 1), epitome, NULL, 7, options, is_ban FROM dec
  UNION ALL SELECT run_id, seq, 2, episode_id, 'episode', 'deterministically_derived', episode_id, NULL, NULL, 4, '', FALSE FROM ep
  UNION ALL SELECT run_id, {O.LAST}, 3, decision_id || '->' || episode_id, 'binding', 'deterministically_derived', 'binding:' || decision_id || '->' || episode_id || ':Produced', NULL, t_gen, 5, '', FALSE FROM bind
)"""
_ROUND = "(CASE WHEN {0} IS NULL OR isnan({0}) THEN 0.0 ELSE sign({0}) * floor(abs({0}) * 1e6 + 0.5) / 1e6 END)::DOUBLE"
_POLY = "0.17087277"
for _c in reversed(T.ERFC[:-1]):
    _POLY = f"({_c}::DOUBLE + tt * {_POLY})"
_TRIM = "regexp_replace(regexp_replace({0}, '^\\s+', ''), '\\s+$', '')"
_COUNT = "(length({0}) - length(translate({0}, {1}, '')))"
_AZ = _q(T._LETTERS)
_JUNK = (
    "((x <> '' AND NOT regexp_matches(x, '\\s') AND (starts_with(x, '<') OR starts_with(x, '[') OR starts_with(x, 'http://') OR starts_with(x, 'https://') OR contains(x, '/') OR contains(x, '::')"
    " OR (strlen(x) >= 12 AND regexp_matches(x, '[0-9]') AND (contains(x, '_') OR contains(x, '-')))))"
    f" OR (length(x) >= 24 AND {_COUNT.format('x', _q(T._STRUCTURAL))}::DOUBLE / length(x) > 0.18) OR "
    + " OR ".join(f"regexp_matches(x, {_q('(?i)' + p)})" for p in R.LINE_REJECTS) + ")"
)
_WORDS = f"len(list_filter(string_split_regex({{0}}, '\\s+'), lambda w: {_COUNT.format('w', _AZ)} >= 2))"
_REDACTED = "html"
for _label, _pattern in R.SECRETS:
    _REDACTED = f"regexp_replace({_REDACTED}, {_q(_pattern)}, '[REDACTED:{_label}]', 'g')"
_DECODED = "html"
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
    _DECODED = f"replace({_DECODED}, {_q(_a)}, {_q(_b)})"

QUERIES = {
    f.__name__: f
    for f in (
        event_kinds, gate_markers, conversation_nodes, episode_nodes, edited_sessions, superseded_turns, decision_nodes, binding_edges, binding_statistics, node_counts, node_order, node_rows, node_records,
        file_shapes, phrase_judgements, read_times, document_lines, prose_lines, turn_words, language_like, redacted_pages, tools_of_urls,
    )
}

ORACLES = {
    "event_kinds": f"WITH {_EVENTS} SELECT run_id, kind, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM ev GROUP BY ALL",
    "gate_markers": f"WITH {_EVENTS} SELECT run_id, seq, i, m.rule_id AS rule_id, m.category AS category, m.tier AS tier, m.matched_text AS matched_text, m.place AS \"offset\" FROM (SELECT run_id, seq, unnest(ms) AS m, generate_subscripts(ms, 1) - 1 AS i FROM (SELECT run_id, seq, list_filter({_MARKERS}, lambda x: x.matched_text <> '') AS ms FROM ev WHERE text IS NOT NULL))",
    "episode_nodes": f"WITH {_EVENTS}, {_EPISODES} SELECT run_id, seq, path, episode_id FROM ep",
    "edited_sessions": f"WITH {_EVENTS}, {_EPISODES} SELECT DISTINCT run_id, run_id AS session_id FROM ep",
    "superseded_turns": f"WITH {_EVENTS}, {_SUPERSEDED} SELECT * FROM sup",
    "decision_nodes": _ALL + " SELECT run_id, seq, epitome, options, is_ban, score, fact_status, superseded_by, decided_by, n_markers::INT AS n_markers FROM dec",
    "conversation_nodes": _ALL + " SELECT run_id, seq, prose, n_markers::INT AS n_markers FROM turns WHERE kind = 'user_turn'",
    "node_order": _EVERY + " SELECT run_id, seq, rank, secondary, node FROM every",
    "node_rows": _EVERY + " SELECT pk, node AS node_type, CASE fact_status WHEN 'observed' THEN 'Observed' WHEN 'deterministically_derived' THEN 'DeterministicallyDerived' ELSE 'StatisticallyRanked' END AS fact_status, epitome, strftime(make_timestamp(t_gen * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS t_gen FROM every",
    "node_records": _EVERY + " SELECT CASE node WHEN 'episode' THEN 2 WHEN 'binding' THEN 4 ELSE 1 END AS kind, t_gen AS valid_at, 1717200000::BIGINT AS transaction_at, count(*) AS n, sum(props)::BIGINT AS n_properties, count(*) FILTER (node = 'episode') AS n_episodes FROM every GROUP BY ALL",
    "file_shapes": _EVERY + " SELECT run_id, count(*) FILTER (node = 'conversation') AS conversations, count(*) FILTER (node = 'decision') AS decisions, count(*) FILTER (node = 'episode') AS episodes, count(*) FILTER (node = 'binding') AS bindings, count(*) FILTER (ban) AS bans, coalesce(array_to_string(list_sort(list_distinct(flatten(list(CASE WHEN options = '' THEN [] ELSE string_split(lower(options), ',') END)))), ','), '') AS options FROM every GROUP BY run_id",
    "phrase_judgements": f"WITH {_EVENTS}, judged(text, committal, is_ban, polar_options, act, choice, mechanism, unbound, resolved, languageness) AS (VALUES " + ", ".join("(" + ", ".join(map(_value, (t, *j))) + ")" for t, j in zip(PHRASES, JUDGED, strict=True)) + f"""), seen AS (SELECT DISTINCT text FROM ev WHERE text IS NOT NULL), found AS (SELECT text, list_filter({_MARKERS}, lambda x: x.matched_text <> '') AS ms FROM seen)
SELECT text, committal, is_ban, polar_options, act, choice, mechanism, unbound, resolved, languageness::DOUBLE AS languageness, len(ms) > 0 AS admits, len(list_filter(ms, lambda m: m.category <> 'confirmation' AND m.tier = 'strong')) > 0 AS seeds,
  CASE WHEN len(list_filter(ms, lambda m: m.category <> 'confirmation' AND m.tier = 'strong')) > 0 THEN 'strong' WHEN len(list_filter(ms, lambda m: m.category <> 'confirmation')) > 0 THEN 'soft' ELSE 'none' END AS tier FROM found JOIN judged USING (text)""",
    "read_times": "SELECT event_id, CASE event_id % 10 WHEN 0 THEN s * 1000000 WHEN 1 THEN s * 1000000 WHEN 2 THEN (s * 1000 + 7) * 1000 WHEN 5 THEN (s - 5400) * 1000000 + (epoch_us(ts) // 1000 % 1000) * 1000 WHEN 7 THEN year(ts) * 1000000 WHEN 8 THEN (s + 7200) * 1000000 END::BIGINT AS micros FROM (SELECT event_id, ts, epoch_us(ts) // 1000000 AS s FROM events)",
    "binding_edges": _ALL + " SELECT * FROM bind",
    "binding_statistics": _ALL
    + f""", counts AS (
  SELECT decision_id, episode_id, count(*) OVER (PARTITION BY run_id, decision_id, path) AS n11, count(*) OVER (PARTITION BY run_id, decision_id) AS r1,
    count(*) OVER (PARTITION BY run_id, path) AS c1, count(*) OVER (PARTITION BY run_id) AS n FROM bind
), st AS (
  SELECT *, n11::DOUBLE / n AS support_, n11::DOUBLE / r1 AS conf_, CASE WHEN r1 = n OR c1 = n THEN 0.0 ELSE (n11::DOUBLE * (n - r1 - c1 + n11) - (r1 - n11)::DOUBLE * (c1 - n11)) / sqrt(r1::DOUBLE * (n - r1) * c1 * (n - c1)) END AS phi_ FROM counts
), st2 AS (SELECT *, conf_ / (c1::DOUBLE / n) AS lift_, sqrt(n * phi_ * phi_ / 2.0) AS z, 1.0::DOUBLE / (1.0 + 0.5 * sqrt(n * phi_ * phi_ / 2.0)) AS tt FROM st)
SELECT decision_id, episode_id, CASE WHEN r1 >= 2 THEN {_ROUND.format('support_')} END AS support, CASE WHEN r1 >= 2 THEN {_ROUND.format('conf_')} END AS confidence,
  CASE WHEN r1 >= 2 THEN {_ROUND.format('lift_')} END AS lift, CASE WHEN r1 >= 2 THEN {_ROUND.format('phi_')} END AS phi, round(CASE WHEN r1 >= 2 THEN {_ROUND.format(f'(tt * exp(-z * z + {_POLY}))')} END, 4) AS p FROM st2""",
    "node_counts": _EVERY + " SELECT node, fact_status, count(*) AS n FROM every GROUP BY ALL",
    "document_lines": """SELECT doc_id, i AS line_no, (sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - strlen(line) - 1)::BIGINT AS byte_offset, strlen(line) AS n_bytes
FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, CASE WHEN ends_with(text, chr(10)) OR text = '' THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS ls FROM documents))""",
    "prose_lines": f"SELECT doc_id, coalesce(md5(CASE WHEN {_WORDS.format('p')} >= 3 THEN p END), '-') AS prose_md5 FROM (SELECT doc_id, {_TRIM.format('c')} AS p FROM (SELECT doc_id, array_to_string(list_filter(string_split_regex(text, '\\r?\\n'), lambda y: {_TRIM.format('y')} <> '' AND NOT {_JUNK.replace('x,', _TRIM.format('y') + ',').replace('(x)', '(' + _TRIM.format('y') + ')').replace('(x <>', '(' + _TRIM.format('y') + ' <>')}), chr(10)) AS c FROM documents))",
    "turn_words": f"SELECT role, count(*) AS turns, sum({_WORDS.format('text')})::BIGINT AS words, count(*) FILTER ({_QUESTION.format('text')}) AS questions, count(*) FILTER ({_COUNT.format('text', _AZ)} >= 12 AND {_COUNT.format('text', _q(T._UPPER))}::DOUBLE / {_COUNT.format('text', _AZ)} > 0.6) AS shouts FROM conversations GROUP BY role",
    "language_like": f"""WITH d AS (SELECT lang, CASE WHEN doc_id % 3 = 0 THEN md5(text) || '#=;' || translate(substr(text, 1, 300), 'aeiouyAEIOUY ', '#=;{{}}[]|0!') WHEN doc_id % 5 = 1 THEN translate(substr(text, 1, 80), '{T._LOWER}', '{T._UPPER}') ELSE text END AS text FROM documents),
s AS (SELECT lang, text, {_TRIM.format('text')} AS s FROM d),
c AS (SELECT lang, text, s, length(s)::FLOAT AS total, {_COUNT.format('s', _AZ)}::FLOAT AS letters, {_COUNT.format('s', "'aeiouyAEIOUY'")}::FLOAT AS vowels, length(regexp_replace(s, '[A-Za-z0-9\\s]', '', 'g'))::FLOAT AS symbols, list_filter(string_split_regex(s, '\\s+'), lambda w: w <> '') AS ws FROM s),
p AS (SELECT *, (letters / total)::FLOAT AS alpha, CASE WHEN letters > 0 THEN (vowels / letters)::FLOAT ELSE 0::FLOAT END AS vowel, (symbols / total)::FLOAT AS symbol, (len(list_filter(ws, lambda w: length(w) <= 3 OR (length(w) <= 32 AND {_COUNT.format('w', "'aeiouyAEIOUY'")} > 0)))::FLOAT / greatest(len(ws), 1)::FLOAT)::FLOAT AS likely FROM c),
r AS (SELECT *, CASE WHEN s = '' THEN 0::FLOAT ELSE (1::FLOAT - CASE WHEN alpha < 0.55::FLOAT THEN (0.55::FLOAT - alpha) * 1.2::FLOAT ELSE 0::FLOAT END - CASE WHEN vowel < 0.30::FLOAT THEN (0.30::FLOAT - vowel) * 1.5::FLOAT ELSE 0::FLOAT END
  - (1::FLOAT - likely) * 0.6::FLOAT - CASE WHEN symbol > 0.30::FLOAT THEN (symbol - 0.30::FLOAT) * 1.2::FLOAT ELSE 0::FLOAT END - CASE WHEN coalesce(list_max(list_transform(ws, lambda w: length(w))), 0) >= 40 THEN 0.4::FLOAT ELSE 0::FLOAT END) END AS score FROM p)
SELECT lang, count(*) AS docs, count(*) FILTER (score < 0.35::FLOAT) AS garbage, count(*) FILTER (starts_with(lower(text), 'echo ') OR contains(text, '####') OR contains(text, '::') OR contains(text, '->') OR {_COUNT.format('text', _q(T._CODE))}::DOUBLE / greatest(length(text), 1) > 0.12) AS code,
  count(*) FILTER ({_COUNT.format('text', _AZ)} >= 12 AND {_COUNT.format('text', _q(T._UPPER))}::DOUBLE / {_COUNT.format('text', _AZ)} > 0.6) AS shouts FROM r GROUP BY lang""",
    "redacted_pages": f"SELECT page_id, {' OR '.join(f'regexp_matches(html, {_q(p)})' for _, p in R.SECRETS)} AS secret, md5({_REDACTED}) AS redacted_md5, md5({_DECODED}) AS decoded_md5 FROM pages",
    "tools_of_urls": f"SELECT page_id, CASE " + " ".join(f"WHEN contains(lower(path), {_q(a)}) THEN {_q(b)}" for a, b in T.PATH_PARTS) + " WHEN ends_with(lower(path), '.ndjson') THEN 'otel' END AS tool, CASE " + " ".join(f"WHEN lower(place) IN ({', '.join(map(_q, names))}) THEN {_q(slug)}" for slug, names in T.ALIASES.items()) + f" END AS named FROM (SELECT page_id, place, '/home/' || place || regexp_replace(url, '^.*://', '/') || CASE WHEN page_id % 2 = 0 THEN '.ndjson' ELSE '.jsonl' END AS path FROM (SELECT *, ([{', '.join(map(_q, _PLACES))}])[page_id % {len(_PLACES)} + 1] AS place FROM pages))",
}
