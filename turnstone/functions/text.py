"""Scalar functions on transcript text, as Column expressions: no Python on the executors.

Patterns get the prefix (?iU) or (?U), which makes classes and boundaries Unicode,
and lower-casing is of A-Z only, so that offsets don't move.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LETTERS = _UPPER + _LOWER
_STRUCTURAL = "{}[]()<>|;=:\"*^/\\"
_CODE = "{}[]()<>=|\\`#;"
_DIGITS = "0123456789"


def once(value: Column, use) -> Column:
    """use(value) with value bound to a variable, so that it stands in the plan once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")


# ---- markers ----


def matches(text: Column, table=R.RULES) -> Column:
    """What each rule first matches, in order of the rules; empty where nothing."""
    return F.array(*[F.regexp_extract(text, "(?idU)" + pattern, 0) for *_, pattern in table])


def before_matches(text: Column, found: Column, table=R.RULES) -> Column:
    """The text before each first match; null where found, from matches(), is empty."""
    return F.array(*[F.when(F.get(found, F.lit(i)) != "", F.get(F.split(text, "(?idU)" + pattern, 2), F.lit(0))) for i, (*_, pattern) in enumerate(table)])


def markers_of(found: Column, before: Column, table=R.RULES) -> Column:
    """Markers in order of the rules: rule_id, category, tier, matched_text, offset in UTF-8 bytes, and place in characters."""
    rules = F.array(*[F.struct(F.lit(a).alias("rule_id"), F.lit(b).alias("category"), F.lit(c).alias("tier")) for a, b, c, _ in table])
    every = F.transform(
        F.arrays_zip(rules.alias("r"), found.alias("m"), before.alias("b")),
        lambda x: F.struct(x["r"]["rule_id"].alias("rule_id"), x["r"]["category"].alias("category"), x["r"]["tier"].alias("tier"), x["m"].alias("matched_text"), F.octet_length(x["b"]).cast("bigint").alias("offset"), F.length(x["b"]).alias("place")),
    )
    return F.filter(every, lambda m: m["matched_text"] != "")


def markers(text: Column, table=R.RULES) -> Column:
    """Markers of a text in order of the rules. table: (id, category, tier, pattern) rules, such as those of gate()."""
    return once(text, lambda t: once(matches(t, table), lambda found: markers_of(found, before_matches(t, found, table), table)))


def gate(rules) -> tuple[tuple[str, str, str, str], ...]:
    """A rule table from (id, category, pattern) triples, which are strong, or (id, category, tier, pattern) quads."""
    out = tuple((r[0], r[1], "strong", r[2]) if len(r) == 3 else tuple(r) for r in rules)
    for name, category, tier, _ in out:
        if category not in R.CATEGORY_BONUS or tier not in ("strong", "soft"):
            raise ValueError(f"rule {name}: unknown category {category} or tier {tier}")
    return out


def admits(text: Column, table=R.RULES) -> Column:
    hit = F.lit(False)
    for *_, pattern in table:
        hit = hit | text.rlike("(?idU)" + pattern)
    return hit


def is_ban(found: Column) -> Column:
    return F.exists(found, lambda m: m["category"] == "ban")


def _strength(found: Column) -> Column:
    """0 none, 1 soft, 2 strong; confirmations don't count."""
    one = lambda m: F.when(m["category"] == "confirmation", 0).when(m["tier"] == "strong", 2).otherwise(1)
    return F.coalesce(F.array_max(F.transform(found, one)), F.lit(0))


def strongest_tier(found: Column) -> Column:
    """strong, soft or none; confirmations don't count."""
    return F.get(F.array(F.lit("none"), F.lit("soft"), F.lit("strong")), _strength(found))


def seeds_decision(found: Column, edited: Column) -> Column:
    """A strong marker, or a soft one in a session with a successful edit."""
    return F.get(F.array(F.lit(False), edited, F.lit(True)), _strength(found))


def category_bonus(found: Column) -> Column:
    def bonus(m: Column) -> Column:
        out = F.lit(0.0).cast("float")
        for name, value in R.CATEGORY_BONUS.items():
            out = F.when(m["category"] == name, F.lit(value).cast("float")).otherwise(out)
        return out

    return F.coalesce(F.array_max(F.transform(found, bonus)), F.lit(0.0).cast("float"))


def seed_score(found: Column, edited: Column, ban: Column, question: Column) -> Column:
    """Tier, category, edit, ban and question terms, in single precision and in this order.

    Each argument stands once in the expression, so that filters on the result can
    be pushed down without growing.
    """
    f = lambda x: F.lit(x).cast("float")
    base = F.get(F.array(*[f(R.TIER_BASE[t]) for t in ("none", "soft", "strong")]), _strength(found))
    score = (base + category_bonus(found)).cast("float")
    score = (score + F.when(edited, f(0.25)).otherwise(f(0.05))).cast("float")
    score = (score + F.when(ban, f(0.10)).otherwise(f(0.0))).cast("float")
    score = (score - F.when(question, f(0.30)).otherwise(f(0.0))).cast("float")
    return F.least(f(1.0), F.greatest(f(0.0), score))


def tier_for(score: Column) -> Column:
    least = F.array(*[F.lit(x).cast("float") for x, _ in reversed(R.TIERS)])
    names = F.array(F.lit(None).cast("string"), *[F.lit(n) for _, n in reversed(R.TIERS)])
    return F.get(names, F.size(F.filter(least, lambda x: x <= score)))


# ---- hygiene ----


def alpha_word_count(text: Column) -> Column:
    """Tokens with two ASCII letters or more."""
    return F.size(F.filter(tokens(text), lambda t: _count(t, _LETTERS) >= 2))


def is_bare_token(line: Column) -> Column:
    """One id, URL, path or markup token; line is trimmed."""
    t = line
    one = (t != "") & ~t.rlike(r"(?U)\s")
    marked = t.startswith("<") | t.startswith("[") | t.startswith("http://") | t.startswith("https://") | t.contains("/") | t.contains("::")
    opaque = (F.octet_length(t) >= 12) & (_count(t, _DIGITS) > 0) & (t.contains("_") | t.contains("-"))
    return one & (marked | opaque)


def is_punctuation_dominated(line: Column) -> Column:
    n = F.length(line)
    return (n >= 24) & (_count(line, _STRUCTURAL).cast("double") / n.cast("double") > 0.18)


def is_junk_line(line: Column, extra: tuple[str, ...] = ()) -> Column:
    """line is trimmed. Patterns run only where a line has a character, or a word, that one of them needs."""
    alternatives = lambda some: "(?idU)" + "|".join(f"(?:{p})" for p in some)
    wordy = tuple(p for p in R.LINE_REJECTS if p in R.WORDY_REJECTS)
    marked = tuple(p for p in R.LINE_REJECTS if p not in R.WORDY_REJECTS)
    out = is_bare_token(line) | is_punctuation_dominated(line)
    out = out | (line.rlike(R.MARKS) & line.rlike(alternatives(marked)))
    out = out | once(ascii_lower(line), lambda low: reduce(lambda a, b: a | b, [low.contains(w) for w in R.WORDY_REJECTS.values()]) & line.rlike(alternatives(wordy)))
    return out | line.rlike(alternatives(extra)) if extra else out


def clean_prose(text: Column, extra: tuple[str, ...] = ()) -> Column:
    """Lines that aren't junk, joined by newlines; null if they hold under three words."""
    left = F.array_join(F.filter(F.split(text, r"\r?\n"), lambda x: once(trim(x), lambda t: (t != "") & ~is_junk_line(t, extra))), "\n")
    return once(trim(left), lambda t: F.when(alpha_word_count(t) >= 3, t))


def languageness(text: Column) -> Column:
    """How much a text looks like language, 0 to 1, in single precision."""
    f = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("float")

    def of(s: Column) -> Column:
        letters, vowels = _count(s, _LETTERS), _count(s, "aeiouyAEIOUY")
        symbols = F.length(F.regexp_replace(s, r"(?U)[A-Za-z0-9\s]", ""))

        def with_words(words: Column) -> Column:
            total, count = f(F.length(s)), f(F.greatest(F.size(words), F.lit(1)))
            like = f(F.size(F.filter(words, lambda t: (F.length(t) <= 3) | ((F.length(t) <= 32) & (_count(t, "aeiouyAEIOUY") > 0)))))
            longest = F.coalesce(F.array_max(F.transform(words, F.length)), F.lit(0))
            alpha, symbol = f(letters) / total, f(symbols) / total
            vowel = F.when(letters > 0, f(f(vowels) / f(letters))).otherwise(f(0.0))
            score = f(f(1.0) - F.when(f(alpha) < f(0.55), f(f(f(0.55) - f(alpha)) * f(1.2))).otherwise(f(0.0)))
            score = f(score - F.when(vowel < f(0.30), f(f(f(0.30) - vowel) * f(1.5))).otherwise(f(0.0)))
            score = f(score - f(f(f(1.0) - f(like / count)) * f(0.6)))
            score = f(score - F.when(f(symbol) > f(0.30), f(f(f(symbol) - f(0.30)) * f(1.2))).otherwise(f(0.0)))
            score = f(score - F.when(longest >= 40, f(0.4)).otherwise(f(0.0)))
            return F.when(s == "", f(0.0)).otherwise(F.least(f(1.0), F.greatest(f(0.0), score)))

        return once(tokens(s), with_words)

    return once(trim(text), of)


def is_garbage(text: Column) -> Column:
    return languageness(text) < F.lit(0.35).cast("float")


def is_shouting(text: Column) -> Column:
    """Twelve letters or more, over six tenths of them capitals."""
    letters = _count(text, _LETTERS)
    return (letters >= 12) & (_count(text, _UPPER).cast("double") / letters.cast("double") > 0.6)


# How questions begin, and what makes one inside a text.
QUESTION_LEADS = (
    "how ", "what ", "whats ", "what's ", "why ", "when ", "where ", "which ", "can you",
    "could you", "should we", "should i", "do we ", "does ", "is it", "are we",
)
QUESTION_INSIDE = ("could you", "can you", "what other", "how do we", "do i need", "is it ready")


def is_question(text: Column) -> Column:
    lower, hit = ascii_lower(text), text.endswith("?")
    for lead in QUESTION_LEADS:
        hit = hit | lower.startswith(lead)
    for inside in QUESTION_INSIDE:
        hit = hit | lower.contains(inside)
    return hit


def looks_like_code_or_log(text: Column) -> Column:
    signal = ascii_lower(text).startswith("echo ") | text.contains("####") | text.contains("::") | text.contains("->")
    return signal | (_count(text, _CODE).cast("double") / F.greatest(F.length(text), F.lit(1)).cast("double") > 0.12)


def decode_entities(text: Column) -> Column:
    """Five HTML entities; &amp; last, so nothing is decoded twice."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


# ---- secrets ----


def contains_secret(text: Column, table=R.SECRETS) -> Column:
    hit = F.lit(False)
    for _, pattern in table:
        hit = hit | text.rlike(pattern)
    return hit


def redact(text: Column, table=R.SECRETS, content: bool = True) -> Column:
    """Secrets become [REDACTED:label], in the table's order; without content, all text goes."""
    if not content:
        return F.when(text.isNotNull(), F.lit("[content elided]"))
    for label, pattern in table:
        text = F.regexp_replace(text, pattern, f"[REDACTED:{label}]")
    return text


# ---- numbers and names ----


RFC3339 = r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)$"


def parse_ts(text: Column) -> Column:
    """RFC 3339, else whole seconds since 1970, or milliseconds beyond 10^10 in size; null for anything else or out of range."""

    def of(t: Column) -> Column:
        n = F.when(t.rlike(r"^[+-]?\d{1,18}$"), t.try_cast("bigint"))
        millis = F.when(F.abs(n) <= 253_402_300_799_999, F.timestamp_millis(n))
        return F.when(t.rlike(RFC3339), F.try_to_timestamp(F.upper(t))).when(F.abs(n) > 10_000_000_000, millis).otherwise(F.timestamp_seconds(n))

    return once(trim(text), of)


def round6(x: Column) -> Column:
    """Six decimals, halves away from zero; what isn't finite is 0."""
    return once(x, lambda v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(F.signum(v) * F.floor(F.abs(v) * 1e6 + 0.5) / 1e6))


# Coefficients of the complementary error function's rational approximation.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(x: Column) -> Column:
    def at(v: Column) -> Column:
        z = F.abs(v)

        def of(t: Column) -> Column:
            poly = F.lit(ERFC[-1])
            for c in reversed(ERFC[:-1]):
                poly = F.lit(c) + t * poly
            return t * F.exp(-z * z + poly)

        return once(once(1.0 / (1.0 + 0.5 * z), of), lambda y: F.when(v >= 0, y).otherwise(2.0 - y))

    return once(x, at)


# Other names of each tool, and what in a path tells it, first match first.
ALIASES = {
    "claude_code": ("claude_code", "claude", "claude-code"), "codex": ("codex",), "gemini": ("gemini",), "otel": ("otel", "opentelemetry"),
    "cursor": ("cursor",), "windsurf": ("windsurf",), "zed": ("zed",), "vscode": ("vscode", "vs_code", "vs-code", "code"), "copilot": ("copilot", "github_copilot"),
    "hermes": ("hermes", "hermes_agent", "hermes-agent"), "opencode": ("opencode", "open_code", "open-code"), "unknown": ("unknown",),
}
PATH_PARTS = (("codex", "codex"), ("claude", "claude_code"), ("gemini", "gemini"), ("cursor", "cursor"), ("windsurf", "windsurf"), ("zed", "zed"), ("copilot", "copilot"), ("hermes", "hermes"), ("opencode", "opencode"), ("code", "vscode"), ("otel", "otel"))


def parse_source(name: Column) -> Column:
    s, out = ascii_lower(trim(name)), F.lit(None).cast("string")
    for slug, names in ALIASES.items():
        out = F.when(s.isin(*names), slug).otherwise(out)
    return out


def infer_source(path: Column) -> Column:
    p = ascii_lower(path)
    out = F.when(p.endswith(".ndjson"), "otel")
    for part, slug in reversed(PATH_PARTS):
        out = F.when(p.contains(part), slug).otherwise(out)
    return out
