"""Substring dedup by repeated-phrase automata.

A window of 13 words is keyed by its anchor, its rightmost 4-gram of least hash, so
equal windows meet at equal anchors. Runs of windows with an anchor that only one
document has end there. Runs equal to one of a smaller doc_id are settled by hash.
The others are read as text again and dealt out by anchor: each shard confirms the
windows that recur, compiles them to an Aho-Corasick automaton, and streams the
shard's passages through it to locate every occurrence of each.

An anchor with more than MAX_RUNS different runs doesn't fit one shard; its windows
are counted by hash instead, which spreads over all tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, pieces, stored
from .kernels import Spans, anchored_runs, signed, text_bytes, words
from .suffix_dedup import _rows, keyed, merged

WINDOW = 13
GRAM = 4
MAX_RUNS = 4000
#: Words in the passages of one automaton, more only where one anchor has more.
SHARD_WORDS = 200_000
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def runs(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """h, rh, doc_id, t, s, n: anchor, hash of the run's words, row, first word, number of windows."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                data, offsets = text_bytes(batch.column(2))
                start, end, first = words(data, offsets)
                if len(start) < window:
                    continue
                spans = Spans(Spans(data).hash(start, end))
                grams = spans.grams(gram)
                s, n, anchor, row = anchored_runs(grams, first, window, gram)
                columns = [
                    pa.array(signed(grams[anchor])),
                    pa.array(signed(spans.hash(s, s + n + window - 1))),
                    batch.column(0).take(pa.array(row)),
                    batch.column(1).take(pa.array(row)),
                    pa.array((s - first[row]).astype(np.int32)),
                    pa.array(n.astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "rh", "doc_id", "t", "s", "n"])

    return docs.mapInArrow(run, f"h long, rh long, doc_id {key}, t int, s int, n int")


def _strings(passages: Iterable[list[bytes]]) -> list[str]:
    number: dict[bytes, str] = {}
    return ["".join([number.setdefault(w, chr(i + 0x100 if i < 0xD000 else i + 0x1000)) for w in ws for i in (len(number),)]) for ws in passages]


def later_windows(passages: list[tuple[list[bytes], object]], window: int) -> list[list[tuple[int, int]]]:
    """For each (words, owner) the spans that windows of a passage with a smaller owner cover.

    Words become characters, so that a window is a short string; windows that two
    passages or more share go into the automaton, with their least owner.
    """
    import ahocorasick

    strings = _strings(ws for ws, _ in passages)
    owner: dict[str, object] = {}
    shared: set[str] = set()
    for x, (_, who) in zip(strings, passages, strict=True):
        for i in range(len(x) - window + 1):
            g = x[i : i + window]
            least = owner.get(g)
            if least is None:
                owner[g] = who
            elif least != who:
                shared.add(g)
                if who < least:
                    owner[g] = who
    out: list[list[tuple[int, int]]] = [[] for _ in passages]
    if not shared:
        return out
    automaton = ahocorasick.Automaton()
    for g in shared:
        automaton.add_word(g, owner[g])
    automaton.make_automaton()
    for spans, x, (_, who) in zip(out, strings, passages, strict=True):
        for end, least in automaton.iter(x):
            if least < who:
                a = end + 1 - window
                if spans and a <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], end + 1)
                else:
                    spans.append((a, end + 1))
    return out


def shared_windows(passages: list[tuple[list[bytes], object, object]], window: int) -> list[list[tuple[int, int]]]:
    """For each (words, least owner, greatest owner) the spans that windows of two owners or more cover."""
    strings = _strings(ws for ws, *_ in passages)
    owners: dict[str, list] = {}
    for x, (_, *own) in zip(strings, passages, strict=True):
        for i in range(len(x) - window + 1):
            g = x[i : i + window]
            seen = owners.get(g)
            owners[g] = own if seen is None else [min(own[0], seen[0]), max(own[1], seen[1])]
    out: list[list[tuple[int, int]]] = []
    for x in strings:
        spans: list[tuple[int, int]] = []
        for i in range(len(x) - window + 1):
            least, most = owners[x[i : i + window]]
            if least < most:
                if spans and i <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], i + window)
                else:
                    spans.append((i, i + window))
        out.append(spans)
    return out


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, both: bool = False) -> DataFrame:
    """doc_id, t, a, b: spans of words that windows of a smaller doc_id cover; docs: from keyed(), doc_id not null.

    both: of any other doc_id, so that no copy stays.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    row_schema = "h long, rh long, a int, b int"
    every = runs(docs, window, gram)
    # Both sides of the joins below are shuffled as they are, so that Spark can split a hot anchor's partition.
    shared = stored(every.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min("rh").alias("lo"), F.max("rh").alias("hi")).where("first < last").select("h", "first", (F.col("lo") == F.col("hi")).alias("same")), "shared")
    hits = stored(every.join(shared, "h"), "hits")
    span = ["doc_id", "t", F.col("s").alias("a"), (F.col("s") + F.col("n") + (window - 1)).alias("b")]
    settled = hits.where("same" if both else "same and doc_id > first").select(*span)
    open_ = hits.where("not same").select("h", "rh", "doc_id", "t", "s", "n")
    classes = stored(open_.groupBy("h", "rh").agg(F.min(F.struct("doc_id", "t", "s", "n")).alias("x"), F.max("doc_id").alias("last")).select("h", "rh", "x.*", "last"), "classes")
    large = stored(classes.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > MAX_RUNS).select("h", F.lit(True).alias("hot")), "large")
    owners = classes.select("h", "rh", F.col("doc_id").alias("owner"), "last")
    owned = stored(open_.join(owners, ["h", "rh"]), "owned")
    settled = settled.unionByName(owned.where("owner < last" if both else "doc_id > owner").select(*span))

    classes = classes.join(large, "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    wanted = classes.groupBy("doc_id", "t").agg(F.collect_list(F.struct("h", "rh", "hot", "last", "s", "n")).alias("runs"))
    read = docs.alias("r").join(wanted.alias("l"), ["doc_id", "t"]).select("doc_id", "t", "r.text", "l.runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for whole in batches:
            for batch in pieces(whole, "text"):
                schema = schema or pa.schema([("h", pa.int64()), ("rh", pa.int64()), ("hot", pa.bool_()), ("doc_id", batch.schema.field(0).type), ("last", batch.schema.field(0).type), ("content", pa.binary())])
                rows = []
                for k, _, text, some in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    found = _WORD.findall(text.encode())
                    rows += [(x["h"], x["rh"], x["hot"], k, x["last"], b" ".join(found[x["s"] : x["s"] + x["n"] + window - 1])) for x in some]
                yield _rows(rows, schema)

    contents = stored(read.mapInArrow(cut, f"h long, rh long, hot boolean, doc_id {key}, last {key}, content binary"), "contents")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("h", pa.int64()), ("rh", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])
        rows: list[tuple] = []
        size, last = 0, None
        limit = SHARD_WORDS * WINDOW // window  # windows are kept as strings, so longer ones take more room

        def solve():
            found = shared_windows([r[2:] for r in rows], window) if both else later_windows([r[2:4] for r in rows], window)
            return _rows([(r[0], r[1], a, b) for r, spans in zip(rows, found, strict=True) for a, b in spans], schema)

        for batch in batches:
            for h, rh, _, owner, most, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= limit and h != last:
                    yield solve()
                    rows, size = [], 0
                rows.append((h, rh, content.split(b" "), owner, most))
                size += len(rows[-1][2])
                last = h
        if rows:
            yield solve()
        rows.clear()
        give_back()

    by_shard = contents.where("not hot").repartition("h").sortWithinPartitions("h").mapInArrow(shards, row_schema)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("content"))
            start, end, first = words(data, offsets)
            spans = Spans(Spans(data).hash(start, end))
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))
            at = np.arange(len(start))
            at, row = at[at + window <= first[row + 1]], row[at + window <= first[row + 1]]
            pick = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(signed(spans.hash(at, at + window))), *[batch.column(j).take(pick) for j in (0, 1, 3, 4)], pa.array((at - first[row]).astype(np.int32))], names=["w", "h", "rh", "owner", "last", "a"])

    hot = contents.where("hot").mapInArrow(windows, f"w long, h long, rh long, owner {key}, last {key}, a int")
    least = hot.groupBy("w").agg(F.min("owner").alias("least"), F.max("last" if both else "owner").alias("most")).where("least < most").select("w", "least")
    by_count = hot.join(least, "w").where("true" if both else "owner > least").select("h", "rh", "a", (F.col("a") + window).alias("b"))
    parts = by_shard.unionByName(by_count)
    rest = owned.where("doc_id = owner").join(parts, ["h", "rh"]).select("doc_id", "t", (F.col("s") + F.col("a")).alias("a"), (F.col("s") + F.col("b")).alias("b"))
    return settled.unionByName(rest)


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row.

    Removes each word covered by a window of words that also starts in a row with a
    smaller doc_id. Null has no words; a null doc_id is compared with none. Rows of
    one doc_id don't remove from each other. Other columns are not read.
    """
    own = keyed(docs)
    spans = repeats(own.where("doc_id is not null"), window, gram)
    spans = spans.groupBy("doc_id", "t").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    joined = own.join(spans, ["doc_id", "t"], "left").select("doc_id", "text", "spans")
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, some in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = _WORD.findall(text.encode())
                kept, at = [], 0
                for a, b in merged((x["a"], x["b"]) for x in some or ()):
                    kept += found[at:a]
                    at = b
                kept += found[at:]
                rows.append((len(found), len(found) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], x) for i, x in enumerate((pa.int64(), pa.int64(), pa.string()))]], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return joined.mapInArrow(run, f"doc_id {key}, n_words long, n_removed long, kept_sha256 string")


def op9(docs: DataFrame) -> DataFrame:
    return without_repeats(docs.select("doc_id", "text"))
