"""Substring dedup by the common-prefix interval tree of an enhanced suffix array.

A window (400 bytes) that starts at two places has the same anchor at both: its
rightmost 200-gram of least hash. So runs of windows are keyed by their anchor and
only runs whose anchor occurs twice go on; equal runs are settled by their hashes
and stand for each other from there on. What is left, runs that agree on the anchor
but not throughout, is read again as bytes, dealt out by anchor, and put in suffix
arrays. A stack scan over the longest common prefixes builds the interval tree; an
interval of at least 400 bytes whose suffixes differ in the byte to their left is a
maximal repeat, and all its suffixes, not just neighbours, are its occurrences.

An anchor with more than MAX_RUNS different runs doesn't fit one suffix array; its
windows are counted by hash instead, which spreads over all tasks.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, fields, pieces, stored
from .kernels import Spans, anchored_runs, signed, text_bytes

WINDOW = 400
GRAM = 200
MAX_RUNS = 4000
#: Bytes of runs in one suffix array, more only where one anchor has more.
ARRAY_BYTES = 1 << 20
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: What ends a sentence, at the end of a word: a mark and what closes quotes or brackets.
_MARK = re.compile("(?:[.!?]|…|。|！|？|؟|।)(?:[\"')\\]]|”|’|»)*$".encode())


# ---- the suffix array ----


def suffix_array(data: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, by prefix doubling from 8 bytes, and the ranks at each doubling.

    bound: for each position the end of its text; bytes behind it don't count, so
    that suffixes of different texts compare as if each text ended in a zero of its own.
    """
    n = len(data)
    at = np.arange(n)
    key = np.zeros(n, np.uint64)
    for i in range(7):  # seven bytes, then the number of them that belong to the text
        j = np.minimum(at + i, n - 1)
        key = (key << np.uint64(8)) | np.where(at + i < bound, data[j], 0).astype(np.uint64)
    key = (key << np.uint64(8)) | np.minimum(7, bound - at).astype(np.uint64)
    levels, size = [], 7
    longest = int((bound - at).max()) if n else 0
    while True:
        order = np.argsort(key)
        new = np.ones(n, bool)
        new[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        levels.append(rank)
        if size >= longest or new.all():
            return order, levels
        j = at + size
        inside = j < bound
        key = (rank.astype(np.uint64) << np.uint64(32)) | np.where(inside, rank[np.minimum(j, n - 1)], 0).astype(np.uint64)
        size *= 2


def common_prefixes(a: np.ndarray, b: np.ndarray, data: np.ndarray, bound: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Lengths of the common prefixes of suffixes a and b, by the ranks of each doubling and then byte by byte."""
    n = len(data)
    out = np.zeros(len(a), np.int64)
    for i in reversed(range(len(levels))):
        size = 7 << i
        for _ in range(2 if i == len(levels) - 1 else 1):
            x, y = a + out, b + out
            ok = (x + size <= bound[a]) & (y + size <= bound[b])
            x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
            out += np.where(ok & (levels[i][x] == levels[i][y]), size, 0)
    live = np.ones(len(a), bool)
    for _ in range(7):
        x, y = a + out, b + out
        live &= (x < bound[a]) & (y < bound[b])
        live &= data[np.minimum(x, n - 1)] == data[np.minimum(y, n - 1)]
        out += live
    return out


def interval_tree(lcp: list[int], left: list[int], least: int) -> Iterator[tuple[int, int, int, bool]]:
    """(length, first, last, diverse) of each interval of at least least bytes, children before parents.

    lcp[i] belongs to suffixes i and i + 1. left: the byte left of each suffix; -1,
    where there is none or it isn't known, differs from any.
    """
    stack: list[list[int]] = []  # length, first, left byte or -1 if they differ
    for i in range(len(left)):
        n, first, own = (lcp[i] if i < len(lcp) else 0), i, left[i]
        while stack and stack[-1][0] > n:
            size, first, seen = stack.pop()
            own = seen = seen if seen == own else -1
            yield size, first, i, seen == -1
        if n >= least:
            if stack and stack[-1][0] == n:
                if stack[-1][2] != own:
                    stack[-1][2] = -1
            else:
                stack.append([n, first, own])


def maximal_repeats(texts: list[bytes], least: int, starts: list[int] | None = None) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(length, [(text, offset)]) of each maximal repeat, longest occurrence lists last.

    starts: how many offsets of each text may begin an occurrence (default: all).
    """
    data, bound, text, begin, lcp, sa, left = _enhanced(texts, least, starts)
    for size, first, last, diverse in interval_tree(lcp.tolist(), left.tolist(), least):
        if diverse:
            yield size, [(int(text[p]), int(p - begin[text[p]])) for p in sa[first : last + 1]]


def _enhanced(texts, least, starts):
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    text = np.repeat(np.arange(len(texts)), sizes)
    bound = (begin + sizes)[text]
    order, levels = suffix_array(data, bound)
    limit = (begin + np.minimum(sizes, np.array(starts) if starts is not None else sizes))[text]
    sa = order[(order < limit[order]) & (bound[order] - order >= least)]
    lcp = common_prefixes(sa[:-1], sa[1:], data, bound, levels)
    left = np.where(sa > begin[text[sa]], data[np.maximum(sa - 1, 0)].astype(np.int64), -1)
    return data, bound, text, begin, lcp, sa, left


def repeated_spans(texts: list[bytes], starts: list[int], least: int) -> list[list[tuple[int, int]]]:
    """For each text the spans that occurrences of maximal repeats cover."""
    _, _, text, begin, lcp, sa, left = _enhanced(texts, least, starts)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if not len(sa):
        return out
    cover = np.zeros(len(sa), np.int64)
    high = np.flatnonzero(lcp >= least)
    if not len(high):
        return out
    cuts = np.flatnonzero(np.diff(high) > 1)
    for a, b in zip(high[np.concatenate([[0], cuts + 1])], high[np.concatenate([cuts, [len(high) - 1]])] + 1, strict=True):
        for size, first, last, diverse in interval_tree(lcp[a:b].tolist(), left[a : b + 1].tolist(), least):
            if diverse:  # children come first and are longer
                part = cover[a + first : a + last + 1]
                np.maximum(part, size, out=part)
    for i in np.flatnonzero(cover):
        p, t = sa[i], text[sa[i]]
        out[t].append((int(p - begin[t]), int(p - begin[t] + cover[i])))
    return [merged(x) for x in out]


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


# ---- the distributed plan ----


def _rows(values: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v[i] for v in values], f.type) for i, f in enumerate(schema)], schema=schema)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, t, text: a row is known by doc_id and a hash of its text, so rows that share both share results."""
    return docs.select("doc_id", F.hash("text").alias("t"), F.coalesce("text", F.lit("")).alias("text"))


def chains(s: np.ndarray, e: np.ndarray, row: np.ndarray, rh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last run of each chain of equal runs of one row that touch or overlap; runs come in order of s."""
    order = np.argsort(rh, kind="stable")
    a, b = order[:-1], order[1:]
    new = np.ones(len(order) + 1, bool)
    new[1:-1] = (rh[a] != rh[b]) | (row[a] != row[b]) | (s[b] > e[a])
    cut = np.flatnonzero(new)
    return order[cut[:-1]], order[cut[1:] - 1]


def runs(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """h, rh, doc_id, t, s, n, x: anchor, hash of the run's content, row, first start, number of starts, bytes that equal runs chained to it add.

    A text that repeats a short piece over and over has the same run at each; all
    repeat each other, so one row stands for the chain and no key gets a row for each.
    """
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                data, offsets = text_bytes(batch.column(2))
                if len(data) < window:
                    continue
                spans = Spans(data)
                grams = spans.grams(gram)
                s, n, anchor, row = anchored_runs(grams, offsets, window, gram)
                e = s + n + (window - 1)
                rh = spans.hash(s, e)
                first, last = chains(s, e, row, rh)
                x = e[last] - e[first]
                s, n, anchor, row, rh = s[first], n[first], anchor[first], row[first], rh[first]
                columns = [
                    pa.array(signed(grams[anchor])),
                    pa.array(signed(rh)),
                    batch.column(0).take(pa.array(row)),
                    batch.column(1).take(pa.array(row)),
                    pa.array((s - offsets[row])),
                    pa.array(n.astype(np.int32)),
                    pa.array(x.astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "rh", "doc_id", "t", "s", "n", "x"])

    return docs.mapInArrow(run, f"h long, rh long, doc_id {key}, t int, s long, n int, x int")


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, t, a, b: spans of bytes that windows starting twice or more cover; docs: from keyed()."""
    key = docs.schema["doc_id"].dataType.simpleString()
    row_schema = f"doc_id {key}, t int, a long, b long"
    every = runs(docs, window, gram)
    count = F.sum(F.when(F.col("x") > 0, 2).otherwise(1)).alias("c")  # a chain is several
    # Both sides of the joins below are shuffled as they are, so that Spark can split a hot anchor's partition.
    shared = stored(every.groupBy("h").agg(count, F.min("rh").alias("lo"), F.max("rh").alias("hi")).where("c > 1").select("h", (F.col("lo") == F.col("hi")).alias("same")), "shared")
    hits = stored(every.join(shared, "h"), "hits")
    open_ = hits.where(~F.col("same")).drop("same")
    classes = stored(open_.groupBy("h", "rh").agg(count, F.min(F.struct("doc_id", "t", "s", "n")).alias("least")).select("h", "rh", "c", "least.*"), "classes")
    large = stored(classes.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > MAX_RUNS).select("h", F.lit(True).alias("hot")), "large")
    classes = classes.join(large, "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    span = ["doc_id", "t", F.col("s").alias("a"), (F.col("s") + F.col("n") + F.col("x") + (window - 1)).alias("b")]
    settled = hits.where("same").select(*span).unionByName(open_.join(classes.where("c > 1").select("h", "rh"), ["h", "rh"], "left_semi").select(*span))

    wanted = classes.groupBy("doc_id", "t").agg(F.collect_list(F.struct("h", "c", "hot", "s", "n")).alias("runs"))
    left, right = wanted.alias("l"), docs.alias("r")
    read = right.join(left, F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.t") == F.col("r.t"))).select("r.doc_id", "r.t", "r.text", "l.runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for whole in batches:
            for batch in pieces(whole, "text"):
                schema = schema or pa.schema([("h", pa.int64()), ("c", pa.int64()), ("hot", pa.bool_()), ("doc_id", batch.schema.field(0).type), ("t", pa.int32()), ("s", pa.int64()), ("n", pa.int32()), ("content", pa.binary())])
                rows = []
                for k, t, text, some in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    data = text.encode()
                    rows += [(x["h"], x["c"], x["hot"], k, t, x["s"], x["n"], data[x["s"] : x["s"] + x["n"] + window - 1]) for x in some]
                yield _rows(rows, schema)

    # A row that stands in the table twice is cut twice; its runs are classes of at least two and only serve as text.
    contents = read.mapInArrow(cut, f"h long, c long, hot boolean, doc_id {key}, t int, s long, n int, content binary")
    contents = stored(contents, "contents")

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        size, schema = 0, None

        def solve():
            found = repeated_spans([r["content"] for r in rows], [r["n"] for r in rows], window)
            out = [(r["doc_id"], r["t"], r["s"] + a, r["s"] + b) for r, spans in zip(rows, found, strict=True) if r["c"] == 1 for a, b in spans]
            return _rows(out, schema)

        for batch in batches:
            schema = schema or pa.schema([("doc_id", batch.schema.field("doc_id").type), ("t", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])
            for r in batch.to_pylist():
                if size >= ARRAY_BYTES and r["h"] != rows[-1]["h"]:
                    yield solve()
                    rows, size = [], 0
                rows.append(r)
                size += len(r["content"])
        if rows:
            yield solve()

    by_array = contents.where("not hot").repartition("h").sortWithinPartitions("h").mapInArrow(arrays, row_schema)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                n = one.column(6)[0].as_py()
                data, _ = text_bytes(one.column(7))
                hashes = Spans(data).hash(np.arange(n), np.arange(n) + window)
                pick = pa.array(np.zeros(n, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(signed(hashes)), *[one.column(j).take(pick) for j in (1, 3, 4)], pa.array(one.column(5)[0].as_py() + np.arange(n))], names=["w", "c", "doc_id", "t", "s"])

    hot = contents.where("hot").mapInArrow(windows, f"w long, c long, doc_id {key}, t int, s long")
    twice = hot.groupBy("w").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("w")
    by_count = hot.where("c = 1").join(twice, "w", "left_semi").select("doc_id", "t", F.col("s").alias("a"), (F.col("s") + window).alias("b"))
    return settled.unionByName(by_array).unionByName(by_count)


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, text: bool = False, keep: list[str] | None = None, phrases: DataFrame | None = None) -> DataFrame:
    """Each row's figures (n_bytes, n_removed, n_spans, kept_sha256), or with text=True the columns in keep with the text left.

    Removes each byte covered by a window that also starts anywhere else, the same
    row included. Null is empty. Rows that stand twice repeat each other and lose
    all windows. With text=True only whole characters go. Other columns aren't read.
    phrases: spans of words (doc_id, t, a, b, as from phrase_dedup.repeats) whose whole sentences go too.
    """
    own = keyed(docs)
    spans = repeats(own, window, gram)
    by_word = phrases is not None
    if by_word:
        spans = spans.withColumn("word", F.lit(False)).unionByName(phrases.withColumn("word", F.lit(True)))
    spans = spans.groupBy("doc_id", "t").agg(F.collect_list(F.struct("a", "b", *["word"][: by_word])).alias("spans"))
    keep = keep or ["doc_id"]
    left = docs.select(*[column(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col("doc_id").alias("doc_id"), F.hash("text").alias("t"), F.col("text").alias("__text")).alias("l")
    joined = left.join(spans.alias("r"), F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.t") == F.col("r.t")), "left")
    joined = joined.select(*[f"l.k{i}" for i in range(len(keep))], "l.__text", "r.spans")
    kept_schema = fields(docs, keep)
    place = keep.index("text") if text else -1
    length = keep.index("n_chars") if text and "n_chars" in keep else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, rows, texts, sizes = list(batch.columns[: len(keep)]), [], [], []
            for body, some in zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist(), strict=True):
                data = (body or "").encode()
                gone = merged((x["a"], x["b"]) for x in some or () if not (by_word and x["word"]))
                if by_word and some:
                    gone = merged(gone + whole_sentences(data, merged((x["a"], x["b"]) for x in some if x["word"])))
                if text:
                    gone = [whole_characters(data, a, b) for a, b in gone]
                parts, at = [], 0
                for a, b in gone:
                    parts.append(data[at:a])
                    at = b
                kept = b"".join([*parts, data[at:]]) if gone else data
                if text:
                    texts.append(body if body is None else kept.decode())
                    sizes.append(None if body is None else len(texts[-1]))
                else:
                    rows.append((len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
            if text:
                columns[place] = pa.array(texts, columns[place].type)
                if length >= 0:
                    columns[length] = pa.array(sizes, columns[length].type)
                yield pa.RecordBatch.from_arrays(columns, names=keep)
            else:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays(columns + [pa.array([r[i] for r in rows], x) for i, x in enumerate(types)], names=[*keep, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(run, kept_schema + ("" if text else ", n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def whole_characters(data: bytes, a: int, b: int) -> tuple[int, int]:
    """The span without characters that it cuts."""
    while a < b and a < len(data) and data[a] & 0xC0 == 0x80:
        a += 1
    while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


def whole_sentences(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The bytes of the sentences that lie whole in spans of words, with the space behind them.

    A sentence starts with the text, after a line break and after a word that ends in a mark.
    """
    if not spans:
        return []
    words = [m.span() for m in _WORD.finditer(data)]
    breaks = [i == 0 or b"\n" in data[words[i - 1][1] : a] or _MARK.search(data, *words[i - 1]) is not None for i, (a, _) in enumerate(words)]
    heads = [i for i, x in enumerate(breaks) if x] + [len(words)]
    out = []
    for a, b in spans:
        first, last = bisect_left(heads, a), bisect_right(heads, b) - 1
        if first < last:
            out.append((words[heads[first]][0], words[heads[last]][0] if heads[last] < len(words) else len(data)))
    return out


def op5(docs: DataFrame) -> DataFrame:
    """without_repeats() of the documents: nulls, ties and repeated rows as there."""
    return without_repeats(docs.select("doc_id", "text"))


def stage(docs: DataFrame, phrases: DataFrame | None = None) -> DataFrame:
    """The documents without the characters that repeated windows cover, n_chars counted anew.

    All rows stay, those that lose all their text with an empty one; null stays null.
    Repeated rows lose their repeats both. Extra columns of any name stay.
    phrases: see without_repeats().
    """
    return without_repeats(docs, text=True, keep=docs.columns, phrases=phrases)
