"""What a text decides: intent, speech act, polarity, sentence, options and score, as Column expressions.

Everything here stands for one value that is used often inside, so arguments are bound
by text.once(); a plan then holds each once, however long the expressions get.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from . import rules as R
from .text import _count, ascii_lower, decode_entities, is_question, is_shouting, languageness, looks_like_code_or_log, once, tokens, trim

OPTION = "array<struct<text:string,chosen:boolean>>"


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _words(names: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def _contains(text: Column, names: tuple[str, ...]) -> Column:
    return F.exists(_words(names), lambda n: F.contains(text, n))


def _starts(text: Column, names: tuple[str, ...]) -> Column:
    return F.exists(_words(names), lambda n: F.startswith(text, n))


def alpha_word_count(text: Column) -> Column:
    return F.size(F.filter(tokens(text), lambda t: F.length(F.regexp_replace(t, "[^A-Za-z]", "")) >= 2))


# ---- intent ----


def is_committal(prose: Column) -> Column:
    """Twelve rules in order: requests and commands commit; questions, fragments and descriptions don't."""

    def of(t: Column) -> Column:
        hit = lambda name: t.rlike("(?idU)" + L.INTENT[name])
        cased = lambda name: t.rlike("(?dU)" + L.INTENT_CASED[name])

        def rest(words: Column) -> Column:
            person = hit("first_person") | hit("second_person")
            third = hit("third_person_lead") | hit("code_lead") | cased("code_ident")
            return (
                F.when(words < L.MIN_WORDS, False)
                .when(hit("subordinate_lead") & (words < L.SUBORDINATE_WORDS), False)
                .when(~person & third, False)
                .when(hit("code_describe") | hit("doc_intro"), False)
                .when(~person & cased("tagline"), False)
                .when(hit("vague_affirm") | hit("infinitive_lead"), False)
                .otherwise(True)
            )

        return F.when(hit("request_leadin"), True).when(t.endswith("?"), False).when(hit("imperative_start"), True).otherwise(once(alpha_word_count(t), rest))

    return once(trim(prose), of)


# ---- speech act ----


def plain_quotes(text: Column) -> Column:
    """Typographic quotes as ASCII ones."""
    return F.translate(text, "‘’ʼ“”", "'''\"\"")


def is_process_narration(text: Column) -> Column:
    return once(ascii_lower(trim(plain_quotes(text))), lambda t: _starts(t, L.PROCESS_HEADS) | _contains(t, L.PROCESS_PHRASES))


def is_agent_narration(text: Column) -> Column:
    return _starts(ascii_lower(trim(plain_quotes(text))), L.SOFT_HEADS)


def is_decisional_act(text: Column) -> Column:
    """A verb that records a choice, in what is neither a question nor an order to the hearer."""

    def of(t: Column) -> Column:
        verb = F.exists(_words(L.DECISIONAL), lambda v: F.startswith(t, v) | F.contains(t, F.concat(F.lit(" "), v)) | F.contains(t, F.concat(F.lit(" "), F.trim(v))))
        return (t != "") & ~t.endswith("?") & ~_starts(t, L.OPENERS) & ~_contains(t, L.DIRECTIVE) & verb

    return once(ascii_lower(trim(text)), of)


# ---- names and subjects ----


def is_name_like(token: Column) -> Column:
    """2 to 40 clean characters, from a letter on, with a capital in front or a digit, dash or dot."""
    return F.coalesce(trim(token).rlike(r"^(?=[A-Za-z0-9_.-]{2,40}\z)(?:[A-Z]|[a-z][A-Za-z_]*[0-9.-])"), F.lit(False))


def has_camelcase(text: Column) -> Column:
    """A word from a letter on with two capitals."""
    return text.rlike(r"(?<![A-Za-z0-9])(?:[A-Z][A-Za-z0-9]*[A-Z]|[a-z][A-Za-z0-9]*[A-Z][A-Za-z0-9]*[A-Z])")


def lead_letters(word: Column) -> Column:
    return ascii_lower(F.regexp_extract(word, "[A-Za-z]+", 0))


def opens_with_unbound_subject(text: Column) -> Column:
    """The first word, or the one after a conjunction, is a pronoun that refers to something else."""

    def of(words: Column) -> Column:
        first, second = lead_letters(F.get(words, F.lit(0))), lead_letters(F.get(words, F.lit(1)))
        return F.coalesce(F.when(first.isin(*L.CONJUNCTIONS), second.isin(*L.UNBOUND)).otherwise(first.isin(*L.UNBOUND)), F.lit(False))

    return once(F.slice(tokens(text), 1, 2), of)


def antecedent_resolved(text: Column) -> Column:
    """A quoted term, code, a name in capitals, or a named thing beyond the first word."""

    def of(t: Column) -> Column:
        named = F.exists(F.slice(tokens(t), 2, 1 << 30), lambda w: is_name_like(F.regexp_replace(w, "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "")))
        return t.contains('"') | t.contains("`") | t.contains("()") | has_camelcase(t) | named

    return once(text, of)


# ---- sentences ----


def sentences(text: Column) -> Column:
    """The sentences of a text with their ends: a newline, or . ! ? before white space, a quote, a paren or the end."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"(?s)(.*?(?:\n|[.!?](?=[ \t\n\x0c\r\"')]|\z))|.+\z)"), F.lit(1)), lambda s: s != "")


def sentence_at(pieces: Column, offset: Column) -> Column:
    """The index of the sentence that holds the character at offset (from 0)."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"))
    return F.aggregate(pieces, start, lambda acc, s: F.struct((acc["at"] + F.length(s)).alias("at"), (acc["k"] + (acc["at"] + F.length(s) <= offset).cast("int")).alias("k")), lambda acc: acc["k"])


def epitome(pieces: Column, k: Column) -> Column:
    return trim(F.coalesce(F.get(pieces, k), F.lit("")))


def epitome_with_antecedent(pieces: Column, k: Column) -> Column:
    """The sentence, with up to two before it if its subject refers to them; no more than 320 characters."""

    def of(base: Column) -> Column:
        before = lambda n: F.when(k >= n, F.get(pieces, k - n))
        some = lambda s: F.coalesce(trim(s) != "", F.lit(False))
        one, two = some(before(1)), some(before(1)) & some(before(2))
        long = trim(F.concat(F.when(two, before(2)).otherwise(""), F.when(one, before(1)).otherwise(""), F.coalesce(F.get(pieces, k), F.lit(""))))
        return F.when(opens_with_unbound_subject(base), once(long, lambda x: F.when(F.length(x) > L.MAX_EPITOME, base).otherwise(x))).otherwise(base)

    return once(epitome(pieces, k), of)


# ---- options ----


def capture_after(text: Column, lower: Column, marker: Column | str) -> Column:
    """The word after the first place of marker, without an article; null where there is none in the clause."""
    m = F.lit(marker) if isinstance(marker, str) else marker

    def of(words: Column) -> Column:
        return F.when(ascii_lower(F.get(words, F.lit(0))).isin("the", "a", "an"), F.get(words, F.lit(1))).otherwise(F.get(words, F.lit(0)))

    at = F.position(m, lower)
    rest = F.regexp_replace(F.substr(text, at + F.length(m), F.length(text)), r"(?U)^\s+", "")
    return F.when(at > 0, once(tokens(F.regexp_extract(rest, r"^[^.,!?;:\n]*", 0)), of))


def parse_options(prose: Column) -> Column:
    """Named alternatives: up to three rejected ones and the first chosen one that isn't among them."""

    def of(lower: Column) -> Column:
        caught = lambda names: F.filter(F.transform(_words(names), lambda m: capture_after(prose, lower, m)), is_name_like)
        option = lambda chosen: lambda x: F.struct(x.alias("text"), F.lit(chosen).alias("chosen"))

        def both(rejected: Column) -> Column:
            fresh = F.filter(caught(L.CHOSEN_AFTER), lambda x: ~F.exists(rejected, lambda y: ascii_lower(y) == ascii_lower(x)))
            return F.concat(F.transform(rejected, option(False)), F.transform(F.slice(fresh, 1, 1), option(True)))

        return once(caught(L.REJECTED_AFTER), both)

    return once(ascii_lower(prose), of).cast(OPTION)


# ---- polarity ----


def _after(text: Column, lower: Column, mark: Column) -> Column:
    at = F.position(mark, lower)
    return F.when(at > 0, F.substr(text, at + F.length(mark), F.length(text)))


def clip_clause(text: Column) -> Column:
    """Up to the first , ; . or ( or else the first for, because, since or so; without quotes around."""

    def of(t: Column) -> Column:
        out = t
        for stop in (" so ", " since ", " because ", " for "):
            out = F.when(t.contains(stop), F.substring_index(t, stop, 1)).otherwise(out)
        out = F.when(t.rlike(r"[,;.(]"), F.regexp_extract(t, r"^[^,;.(]*", 0)).otherwise(out)
        return trim(F.regexp_replace(trim(out), "^[\"`':]+|[\"`':]+\\z", ""))

    return once(trim(text), of)


def first_word(lower: Column) -> Column:
    return F.regexp_extract(lower, r"[a-z]+", 0)


def negated_target(text: Column, lower: Column) -> Column:
    """What a negated verb of action rules out; null where nothing is."""
    verbs = tuple(dict.fromkeys(L.DECISION_VERB_HEAD + L.REMOVAL_LEAD))

    def of(neg: Column) -> Column:
        rest = _after(lower, lower, neg)
        verb = first_word(rest)
        begin = F.position(neg, lower) + F.length(neg) + F.position(verb, rest) - 1 + F.length(verb)
        return F.when(F.array_contains(_words(verbs), verb), clip_clause(F.substr(text, begin, F.length(text))))

    return F.get(F.filter(F.transform(_words(L.BAN_NEGATORS), of), lambda x: x.isNotNull()), F.lit(0))


def chosen_head(left: Column) -> Column:
    """The chosen side of a contrast: after the last to or with, or a verb of choice, else all of it."""

    def of(lower: Column) -> Column:
        last = lambda mark: F.when(lower.contains(mark), F.nullif(clip_clause(F.right(left, F.length(F.substring_index(lower, mark, -1)))), F.lit("")))
        verbs = F.filter(F.transform(_words(L.CHOOSE_VERBS), lambda v: clip_clause(_after(left, lower, v))), lambda x: F.coalesce(x != "", F.lit(False)))
        return F.coalesce(last(" to "), last(" with "), F.get(verbs, F.lit(0)), clip_clause(left))

    return once(ascii_lower(left), of)


def _ruled_out(target: Column) -> Column:
    return once(target, lambda t: F.struct(F.lit(True).alias("is_ban"), F.when((t == "") | (F.octet_length(t) > L.MAX_OPTION), F.array().cast(OPTION)).otherwise(F.array(F.struct(t.alias("text"), F.lit(True).alias("chosen")))).alias("options")))


def _contrast(chosen: Column, rejected: Column) -> Column:
    both = F.array(F.struct(chosen.alias("text"), F.lit(True).alias("chosen")), F.struct(rejected.alias("text"), F.lit(False).alias("chosen")))
    fits = lambda x: (x["text"] != "") & (F.octet_length(x["text"]) <= L.MAX_OPTION)
    return F.struct(F.lit(False).alias("is_ban"), once(both, lambda b: F.when(F.forall(b, fits), b).otherwise(F.array().cast(OPTION))).alias("options"))


def polarity(text: Column) -> Column:
    """struct<is_ban, options>: prohibition, negated action, contrast, from .. to, replace .. with, removal in front, or nothing."""

    def of(t: Column) -> Column:
        def cases(low: Column) -> Column:
            pseudo = _contains(low, L.PSEUDO_NEGATION)
            forbidden = F.get(F.filter(F.transform(_words(L.PROHIBIT), lambda p: _after(t, low, p)), lambda x: x.isNotNull()), F.lit(0))
            pivot = F.get(F.filter(_words(L.INSTEAD_PIVOTS), lambda p: F.contains(low, p)), F.lit(0))
            left, right = F.substr(t, F.lit(1), F.position(pivot, low) - 1), _after(t, low, pivot)

            def between(first: str, second: str) -> tuple[Column, Column]:
                rest, rest_low = _after(t, low, F.lit(first)), _after(low, low, F.lit(first))
                at = F.position(F.lit(second), rest_low)
                return clip_clause(F.when(at > 0, F.substr(rest, F.lit(1), at - 1))), clip_clause(_after(rest, rest_low, F.lit(second)))

            (source, goal), (gone, new) = between(" from ", " to "), between("replace ", " with ")
            given = lambda a, b: F.coalesce((a != "") & (b != ""), F.lit(False))
            lead = F.get(F.split(F.regexp_replace(t, r"(?U)^\s+", ""), r"(?U)\s", 2), F.lit(1))
            negated = F.when(~pseudo, negated_target(t, low))
            return once(
                F.array(F.struct(F.when(~pseudo, forbidden).alias("f"), negated.alias("n"), pivot.alias("p"))),
                lambda a: once(
                    F.get(a, F.lit(0)),
                    lambda s: F.when(s["f"].isNotNull(), _ruled_out(clip_clause(F.regexp_replace(s["f"], "^[ :]+", ""))))
                    .when(s["n"].isNotNull(), _ruled_out(s["n"]))
                    .when(s["p"].isNotNull(), _contrast(chosen_head(left), clip_clause(right)))
                    .when(given(source, goal), _contrast(goal, source))
                    .when(given(gone, new), _contrast(new, gone))
                    .when(~pseudo & first_word(low).isin(*L.REMOVAL_LEAD), _ruled_out(clip_clause(F.coalesce(lead, F.lit("")))))
                    .otherwise(F.struct(F.lit(False).alias("is_ban"), F.array().cast(OPTION).alias("options"))),
                ),
            )

        return once(ascii_lower(t), cases)

    return once(text, of)


def is_decision_clause(segment: Column) -> Column:
    """Two words or more, with a verb of decision in front or a contrast."""

    def of(low: Column) -> Column:
        return (F.size(tokens(low)) >= 2) & (first_word(low).isin(*L.DECISION_VERB_HEAD) | low.contains(" instead of ") | low.contains(" rather than "))

    return once(ascii_lower(trim(segment)), of)


def split_coordinated(text: Column) -> Column:
    """The parts of a list of decisions, if each part is one; else the text as one part."""

    def of(t: Column) -> Column:
        parts = F.filter(F.transform(F.split(t, r",| \+ | and "), lambda p: trim(F.regexp_replace(trim(p), r"\.+\z", ""))), lambda p: p != "")
        return F.when(t.rlike(r"[{(\[]"), F.array(t)).otherwise(once(parts, lambda p: F.when((F.size(p) >= 2) & F.forall(p, is_decision_clause), p).otherwise(F.array(t))))

    return once(trim(text), of)


# ---- the score ----


def is_skill_or_goal(lower: Column, extra: tuple[str, ...] = ()) -> Column:
    """Text of skills and goals; extra: more phrases, such as one product's own."""
    return _contains(lower, L.SKILL_OR_GOAL + extra) | _starts(lower, L.SKILL_LEADS)


def has_named_mechanism(text: Column, lower: Column) -> Column:
    return _contains(lower, L.BEHAVIOUR) & (text.contains("()") | has_camelcase(text))


def has_resolved_choice(text: Column, lower: Column) -> Column:
    named = F.exists(_words(L.CHOICE_OF_NAMED), lambda m: is_name_like(capture_after(text, lower, m)))
    return _contains(lower, L.CHOICE_PHRASES) | named | has_named_mechanism(text, lower)


def is_noise(text: Column, lower: Column) -> Column:
    """Never a decision: skill text, code or logs, shouting, many quotes, no language."""
    return is_skill_or_goal(lower) | looks_like_code_or_log(text) | is_shouting(text) | (_count(text, '"') >= 4) | (languageness(text) < F.lit(0.35).cast("float"))


def score_terms(sentence: Column) -> Column:
    """struct of what the score needs from the sentence alone: noise (the score is 0), choice, mechanism, act, question, pronoun."""

    def of(t: Column) -> Column:
        def with_lower(low: Column) -> Column:
            def with_choice(c: Column) -> Column:
                pronoun = opens_with_unbound_subject(t)
                noise = is_noise(t, low) | is_process_narration(t) | (is_agent_narration(t) & ~c) | (pronoun & ~antecedent_resolved(t))
                return F.struct(noise.alias("noise"), c.alias("choice"), has_named_mechanism(t, low).alias("mechanism"), is_decisional_act(t).alias("act"), is_question(t).alias("question"), pronoun.alias("pronoun"))

            return once(has_resolved_choice(t, low), with_choice)

        return once(ascii_lower(t), with_lower)

    return once(trim(decode_entities(sentence)), of)


def score(terms: Column, strength: Column, bonus: Column, ban: Column, edited: Column) -> Column:
    """The terms in single precision and in this order: tier, category, choice, mechanism, act, edit, ban, question, pronoun."""
    f = lambda x: F.lit(x).cast("float")
    base = F.get(F.array(*[f(R.TIER_BASE[t]) for t in ("none", "soft", "strong")]), strength)
    steps = [(terms["choice"], 0.15, 0.0), (terms["mechanism"], 0.10, 0.0), (terms["act"], 0.12, 0.0), (edited, 0.25, 0.05), (ban, 0.10, 0.0), (terms["question"], -0.30, 0.0), (terms["pronoun"], -0.15, 0.0)]
    out = (base + bonus).cast("float")
    for condition, yes, no in steps:
        out = (out + F.when(condition, f(yes)).otherwise(f(no))).cast("float")
    return F.when(terms["noise"], f(0.0)).otherwise(F.least(f(1.0), F.greatest(f(0.0), out)))
