"""URL filters: rules first, then logistic regression on hashed character n-grams.

The model is fitted on the driver from a small labelled URL table: a DataFrame of url
and label, bounded to MAX_LABELLED rows, or by default one made by a rule from words
that decide and parts that don't (labelled_urls). Weights become whole millionths,
which makes scores exact sums on any engine. Judging is one narrow projection: no
shuffle, no Python on the executors.
"""

from __future__ import annotations

import hashlib
import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, rule); a rule is a host and the beginning of a path.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

# Words that make a site or a page one to keep (0) or to block (1).
_WORDS = (
    "news library docs science weather museum forum recipes university hospital garden history travel music wiki sport council archive school journal",
    "casino viagra cheap-pills xxx-cams poker-bonus free-money spam-farm porn-tube adult-dating payday-loans crack-keygen replica-watches click-fraud "
    "win-prize torrent-free hot-singles pills-discount slots-jackpot get-rich link-farm",
)
_PAGES = (
    "article about lecture guide report visit minutes exhibition lesson thread story review catalogue map concert",
    "buy-now claim-prize jackpot free-spins adult nude serial-crack cheap-deal apply-now-cash bonus-code spam click-here unlock-win pharmacy hot-girls",
)
# Common syllables of names that mean nothing; such hosts are kept.
_SYLLABLES = "an ar ble ed en er es hea in ing is ly nd on or ou re sha st th the ti tion wh".split()
# Parts that say nothing: both classes get all of them.
_FRONTS, _ENDS, _LANGS = ("", "www.", "m.", "blog."), ("example.com", "example.net", "example.org", "example.biz"), ("en", "fr", "de", "es")


def labelled_urls() -> list[tuple[str, int]]:
    """(url, 1 to block or 0): each word with two fronts, domains and languages that say nothing, on plain pages and on telling ones; and hosts of mere syllables."""
    out = []
    for label in (0, 1):
        words, pages = _WORDS[label].split(), _PAGES[label].split()
        for i, word in enumerate(words):
            for j in range(2):
                n = 7 * i + 3 * j
                site = f"{_FRONTS[(i + j) % 4]}{word}.{_ENDS[(i + 2 * j) % 4]}"
                out.append((f"https://{site}/{_LANGS[(n + j) % 4]}/{n * 37 % 1000}", label))
                out.append((f"http://{site}/{_LANGS[n % 4]}/{pages[n % len(pages)]}-{n * 53 % 1000}.html", label))
        for i, page in enumerate(pages):  # a host that says nothing
            out.append((f"https://{_FRONTS[i % 4]}{_nonsense(3 * i)}.{_ENDS[i % 4]}/{_LANGS[i % 4]}/{page}/{i * 29 % 500}", label))
    out += [(f"https://{_FRONTS[i % 4]}{_nonsense(i)}.{_ENDS[i // 4 % 4]}/{_LANGS[i // 16 % 4]}/{i * 37 % 1000}", 0) for i in range(100)]
    return out


def _nonsense(i: int) -> str:
    return "".join(_SYLLABLES[(i * k + k) % len(_SYLLABLES)] for k in (1, 5, 7)[: 2 + i % 2])


MAX_LABELLED = 10_000
BUCKETS = 4096
SIZES = (3, 4)
UNIT = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Null, or without "://": both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: len(r[1])):  # the longest is tested last, so it wins
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        found, verdict = F.when(fits, F.lit(rule)).otherwise(found), F.when(fits, F.lit(what)).otherwise(verdict)
    return found, verdict


def _gram(mark: str, chars: Column, n: int):
    return lambda i: F.concat(F.lit(mark), *[F.get(chars, i + j) for j in range(n)])


def buckets(host: Column, path: Column) -> Column:
    """The buckets of all character n-grams of host and path, each part marked and bounded."""
    parts = []
    for mark, text in (("h", host), ("p", path)):
        chars = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")
        for n in SIZES:
            last = F.size(chars) - n
            places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
            parts.append(F.transform(places, _gram(mark, chars, n)))
    return F.transform(F.concat(*parts), lambda g: F.conv(F.substring(F.md5(g.cast("binary")), 1, 3), 16, 10).cast("int"))


def _host_and_path(url: str) -> tuple[str, str]:
    """host_and_path() on the driver."""
    at = url.find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    stop = min([i for i in (rest.find(c, end) for c in "?#") if i >= 0], default=len(rest))
    return rest[:end].translate(str.maketrans(_UPPER, _LOWER)), rest[end:stop]


def _buckets(host: str, path: str) -> list[int]:
    """buckets() on the driver."""
    grams = []
    for mark, text in (("h", host), ("p", path)):
        text = f"^{text}$"
        grams += [mark + text[i : i + n] for n in SIZES for i in range(len(text) - n + 1)]
    return [int(hashlib.md5(g.encode()).hexdigest()[:3], 16) for g in grams]


def train(labelled: DataFrame | None = None, rounds: int = 300, rate: float = 4.0, l2: float = 1e-4) -> tuple[list[int], int]:
    """Weights of the buckets and the bias, in millionths; batch gradient descent from zero.

    labelled: url and label (1 to block, 0 to keep); rows with nulls take no part, and
    more than MAX_LABELLED are an error, which bounds what comes to the driver. Repeated
    and contradictory rows count each. No rows: zeros.
    """
    if labelled is None:
        pairs = labelled_urls()
    else:
        pairs = [(r.url, r.label) for r in labelled.where("url IS NOT NULL AND label IN (0, 1)").select("url", "label").orderBy("url", "label").take(MAX_LABELLED + 1)]
        if len(pairs) > MAX_LABELLED:
            raise ValueError(f"the labelled URL table is bounded to {MAX_LABELLED} rows")
    x, y = np.zeros((len(pairs), BUCKETS)), np.array([float(label) for _, label in pairs])
    for i, (url, _) in enumerate(pairs):
        found = _buckets(*_host_and_path(url))
        np.add.at(x[i], found, 1 / math.sqrt(max(1, len(found))))
    w, bias = np.zeros(BUCKETS), 0.0
    for _ in range(rounds if len(pairs) else 0):
        e = 1 / (1 + np.exp(-(bias + x @ w))) - y
        w -= rate * (e @ x / len(pairs) + l2 * w)
        bias -= rate * e.mean()
    return [round(UNIT * v) for v in w.tolist()], round(UNIT * float(bias))


def judge(pages: DataFrame, weights: list[int], bias: int, rules=RULES, url: str = "url", key: str = "page_id") -> DataFrame:
    """One row per page: key, host, path, rule, verdict.

    A rule decides where one fits; else the model: logit = bias + sum of the
    weights over sqrt(number of n-grams), block where it is over 0. A null URL or
    one without "://" has empty host and path; where both are empty there are no
    n-grams to go by, so the page is kept, whatever the bias. Repeated rows are judged each; other columns are ignored.
    """
    host, path = host_and_path(F.col(url))
    base = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    table = F.from_json(F.lit(json.dumps(weights)), "array<bigint>")
    total = F.aggregate(F.col("_b"), F.lit(0).cast("bigint"), lambda acc, b: acc + F.get(table, b))
    logit = F.lit(bias) + total / F.sqrt(F.greatest(F.size("_b"), F.lit(1)).cast("double"))
    return (
        base.withColumn("_b", buckets(F.col("host"), F.col("path")))
        .select(key, "host", "path", rule.alias("rule"), F.coalesce(ruled, F.when((F.size("_b") > 0) & (logit > 0), "block").otherwise("allow")).alias("verdict"))
    )


def op10(pages: DataFrame) -> DataFrame:
    """judge() with the default rules and labelled table."""
    return judge(pages.select("page_id", "url"), *train())


def oracle(weights: list[int], bias: int) -> str:
    """DuckDB SQL for op10: the same rules and weights, n-grams by unnesting."""
    rules = ", ".join(f"('{v}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}')" for v, r in RULES)
    w = "[" + ",".join(map(str, weights)) + "]"
    grams = " || ".join(
        f"list_transform(CASE WHEN len(s{m}) >= {n} THEN range(1, len(s{m}) - {n} + 2) ELSE [] END, lambda i: '{m}' || substr(s{m}, i, {n}))" for m in "hp" for n in SIZES
    )
    return f"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), hp AS (
  SELECT row_number() OVER () AS rid, page_id,
    translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(v, h, p, r) AS (VALUES {rules}),
fit AS (
  SELECT rid, arg_max(r, length(r)) AS rule, arg_max(v, length(r)) AS ruled
  FROM hp JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rid
), grams AS (
  SELECT rid, {grams} AS g
  FROM (SELECT *, '^' || host || '$' AS sh, '^' || path || '$' AS sp FROM hp)
), scored AS (
  SELECT rid, {bias} + sum(({w})[(('0x' || substr(md5(x), 1, 3))::INT) + 1])::DOUBLE / sqrt(count(*)) AS logit
  FROM (SELECT rid, unnest(g) AS x FROM grams) GROUP BY rid
)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN logit > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM hp LEFT JOIN fit USING (rid) LEFT JOIN scored USING (rid)
"""
