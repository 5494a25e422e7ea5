"""The judgement of a text in plain Python, one string at a time: what the Column expressions are held against."""

from __future__ import annotations

import re

import numpy as np

from turnstone.functions import lexicon as L
from turnstone.functions import rules as R
from turnstone.functions.text import QUESTION_INSIDE, QUESTION_LEADS

f32 = np.float32


def low(s):
    return s.translate({i: i + 32 for i in range(65, 91)})


def search(pattern, s, flags=re.I):
    return re.search(pattern.replace(r"\z", r"\Z"), s, flags)


def alpha_words(s):
    return sum(len(re.findall("[A-Za-z]", w)) >= 2 for w in s.split())


def prose(text):
    kept = []
    for line in re.split(r"\r?\n", text):
        t = line.strip()
        if t and not junk(t):
            kept.append(line)
    out = "\n".join(kept).strip()
    return out if alpha_words(out) >= 3 else None


def junk(t):
    if not re.search(r"\s", t):
        if t[0] in "<[" or t.startswith(("http://", "https://")) or "/" in t or "::" in t:
            return True
        if len(t.encode()) >= 12 and re.search("[0-9]", t) and ("_" in t or "-" in t):
            return True
    if len(t) >= 24 and sum(c in "{}[]()<>|;=:\"*^/\\" for c in t) / len(t) > 0.18:
        return True
    return any(search(p, t) for p in R.LINE_REJECTS)


def markers(t):
    return [(a, b, c, m.group(), len(t[: m.start()].encode()), m.start()) for a, b, c, p in R.RULES if (m := search(p, t)) and m.group()]


def breaks(t, i):
    return t[i] == "\n" or (t[i] in ".!?" and (i + 1 == len(t) or t[i + 1] in " \t\n\x0c\r\"')"))


def bounds(t, at):
    start = next((i + 1 for i in range(at - 1, -1, -1) if breaks(t, i)), 0)
    end = next((i + 1 for i in range(at, len(t)) if breaks(t, i)), len(t))
    return start, end


def epitome(t, at):
    a, b = bounds(t, at)
    return t[a:b].strip()


def lead(w):
    m = re.search("[A-Za-z]+", w)
    return low(m.group()) if m else ""


def unbound(s):
    w = s.split()
    if w and lead(w[0]) in L.CONJUNCTIONS:
        w = w[1:]
    return bool(w) and lead(w[0]) in L.UNBOUND


def camel(w):
    return bool(w) and w[0].isascii() and w[0].isalpha() and sum("A" <= c <= "Z" for c in w) >= 2


def name_like(t):
    t = t.strip()
    return 2 <= len(t) <= 40 and bool(re.fullmatch("[A-Za-z][A-Za-z0-9_.-]*", t)) and ("A" <= t[0] <= "Z" or any(c.isdigit() or c in "-." for c in t))


def resolved(s):
    if '"' in s or "`" in s or "()" in s or any(camel(w) for w in re.split("[^A-Za-z0-9]", s)):
        return True
    return any(name_like(re.sub("^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "", w)) for w in s.split()[1:])


def with_antecedent(t, at):
    base = epitome(t, at)
    if not unbound(base):
        return base
    start, end = bounds(t, at)
    for _ in range(L.MAX_ANTECEDENT):
        if start == 0:
            break
        before = next((i + 1 for i in range(start - 2, -1, -1) if breaks(t, i)), 0)
        if "\n\n" in t[before:start] or not t[before:start].strip():
            break
        start = before
    out = t[start:end].strip()
    return base if len(out) > L.MAX_EPITOME else out


def committal(s):
    t = s.strip()
    hit = lambda n: bool(search(L.INTENT[n], t))
    cased = lambda n: bool(search(L.INTENT_CASED[n], t, 0))
    if hit("request_leadin"):
        return True
    if t.endswith("?"):
        return False
    if hit("imperative_start"):
        return True
    n = alpha_words(t)
    person = hit("first_person") or hit("second_person")
    if n < 4 or (hit("subordinate_lead") and n < 8):
        return False
    if not person and (hit("third_person_lead") or hit("code_lead") or cased("code_ident")):
        return False
    if hit("code_describe") or hit("doc_intro") or (not person and cased("tagline")):
        return False
    return not (hit("vague_affirm") or hit("infinitive_lead"))


def capture(t, mark):
    at = low(t).find(mark)
    if at < 0:
        return None
    words = re.match(r"[^.,!?;:\n]*", t[at + len(mark) :].lstrip()).group().split()
    if words and low(words[0]) in ("the", "a", "an"):
        words = words[1:]
    return words[0] if words else None


def options(t):
    out = [(x, False) for m in L.REJECTED_AFTER if (x := capture(t, m)) and name_like(x)]
    for m in L.CHOSEN_AFTER:
        x = capture(t, m)
        if x and name_like(x) and low(x) not in [low(y) for y, _ in out]:
            return [*out, (x, True)]
    return out


def clip(s):
    s = s.strip()
    m = re.search("[,;.(]", s)
    end = m.start() if m else next((s.find(x) for x in (" for ", " because ", " since ", " so ") if x in s), len(s))
    return s[:end].strip().strip("\"`':").strip()


def first_word(s):
    m = re.search("[a-z]+", s)
    return m.group() if m else ""


def polarity(t):
    lower = low(t)
    ban = lambda x: (True, [] if not x or len(x.encode()) > 60 else [(x, True)])
    both = lambda a, b: (False, [] if not a or not b or len(a.encode()) > 60 or len(b.encode()) > 60 else [(a, True), (b, False)])
    pseudo = any(p in lower for p in L.PSEUDO_NEGATION)
    if not pseudo:
        for p in L.PROHIBIT:
            if p in lower:
                return ban(clip(t[lower.find(p) + len(p) :].lstrip(" :")))
        for n in L.BAN_NEGATORS:
            if n in lower:
                at = lower.find(n) + len(n)
                m = re.search("[a-z]+", lower[at:])
                if m and m.group() in L.DECISION_VERB_HEAD + L.REMOVAL_LEAD:
                    return ban(clip(t[at + m.end() :]))
    for p in L.INSTEAD_PIVOTS:
        if p in lower:
            at = lower.find(p)
            return both(head(t[:at]), clip(t[at + len(p) :]))
    for a, b in ((" from ", " to "), ("replace ", " with ")):
        if a in lower:
            at = lower.find(a) + len(a)
            if (to := lower.find(b, at)) >= 0:
                gone, new = clip(t[at:to]), clip(t[to + len(b) :])
                if gone and new:
                    return both(new, gone)
    if not pseudo and first_word(lower) in L.REMOVAL_LEAD:
        rest = re.split(r"\s", t.lstrip(), maxsplit=1)
        return ban(clip(rest[1] if len(rest) > 1 else ""))
    return False, []


def head(left):
    lower = low(left)
    for mark in (" to ", " with "):
        if mark in lower and (x := clip(left[lower.rfind(mark) + len(mark) :])):
            return x
    for v in L.CHOOSE_VERBS:
        if v in lower and (x := clip(left[lower.find(v) + len(v) :])):
            return x
    return clip(left)


def languageness(text):
    s = text.strip()
    if not s:
        return f32(0)
    count = lambda p: sum(bool(re.match(p, c)) for c in s)
    total, letters, vowels = f32(len(s)), f32(count("[A-Za-z]")), f32(count("[aeiouyAEIOUY]"))
    symbols = f32(sum(not re.match(r"[A-Za-z0-9\s]", c) for c in s))
    alpha, vowel, symbol = letters / total, vowels / letters if letters else f32(0), symbols / total
    words = s.split()
    like = f32(sum(len(w) <= 3 or (len(w) <= 32 and bool(re.search("[aeiouyAEIOUY]", w))) for w in words)) / f32(max(1, len(words)))
    out = f32(1)
    if alpha < f32(0.55):
        out -= (f32(0.55) - alpha) * f32(1.2)
    if vowel < f32(0.30):
        out -= (f32(0.30) - vowel) * f32(1.5)
    out -= (f32(1) - like) * f32(0.6)
    if symbol > f32(0.30):
        out -= (symbol - f32(0.30)) * f32(1.2)
    if max(map(len, words), default=0) >= 40:
        out -= f32(0.4)
    return min(f32(1), max(f32(0), out))


def mechanism(s):
    return any(v in low(s) for v in L.BEHAVIOUR) and ("()" in s or any(camel(w) for w in re.split("[^A-Za-z0-9]", s)))


def choice(s):
    return any(p in low(s) for p in L.CHOICE_PHRASES) or any((x := capture(s, m)) is not None and name_like(x) for m in L.CHOICE_OF_NAMED) or mechanism(s)


def act(s):
    t = low(s.strip())
    if not t or t.endswith("?") or t.startswith(L.OPENERS) or any(d in t for d in L.DIRECTIVE):
        return False
    return any(t.startswith(v) or " " + v in t or " " + v.strip() in t for v in L.DECISIONAL)


def question(s):
    return s.endswith("?") or low(s).startswith(QUESTION_LEADS) or any(x in low(s) for x in QUESTION_INSIDE)


def score(sentence, found, ban, edited):
    s = sentence
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = s.replace(a, b)
    s = s.strip()
    t = low(s)
    letters = re.findall("[A-Za-z]", s)
    code = t.startswith("echo ") or "####" in s or "::" in s or "->" in s or sum(c in "{}[]()<>=|\\`#;" for c in s) / max(1, len(s)) > 0.12
    shout = len(letters) >= 12 and sum(c.isupper() for c in letters) / len(letters) > 0.6
    skill = any(x in t for x in L.SKILL_OR_GOAL) or t.startswith(L.SKILL_LEADS)
    plain = low(s.translate(str.maketrans("‘’ʼ“”", "'''\"\"")).strip())
    if skill or code or shout or s.count('"') >= 4 or languageness(s) < f32(0.35) or plain.startswith(L.PROCESS_HEADS) or any(p in plain for p in L.PROCESS_PHRASES):
        return f32(0)
    if (plain.startswith(L.SOFT_HEADS) and not choice(s)) or (unbound(s) and not resolved(s)):
        return f32(0)
    tiers = [c for _, b, c, *_ in found if b != "confirmation"]
    out = f32(R.TIER_BASE["strong" if "strong" in tiers else "soft" if tiers else "none"])
    out += max(f32(R.CATEGORY_BONUS[b]) for _, b, *_ in found)
    for yes, value in ((choice(s), 0.15), (mechanism(s), 0.10), (act(s), 0.12)):
        if yes:
            out += f32(value)
    out += f32(0.25) if edited else f32(0.05)
    if ban:
        out += f32(0.10)
    if question(s):
        out -= f32(0.30)
    if unbound(s):
        out -= f32(0.15)
    return min(f32(1), max(f32(0), out))


def decision(text, clean=True):
    """(number of markers, epitome, options, is_ban, score with an edit, score without); epitome None where nothing is decided."""
    t = prose(text) if clean else text
    found = markers(t) if t else []
    fit = [(L.ANCHOR[m[1]], i, m[5]) for i, m in enumerate(found) if committal(epitome(t, m[5]))]
    if not fit:
        return len(found), None, [], False, 0.0, 0.0
    at = min(fit)[2]
    sentence = with_antecedent(t, at)
    if unbound(epitome(t, at)) and not resolved(sentence):
        return len(found), None, [], False, 0.0, 0.0
    ban = polarity(sentence)[0]
    return len(found), sentence, options(t), ban, round(float(score(sentence, found, ban, True)), 4), round(float(score(sentence, found, ban, False)), 4)
