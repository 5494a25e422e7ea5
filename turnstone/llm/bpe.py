"""Byte-level BPE encoding and decoding with DuckDB recursive queries, one per partition's batch.

Each distinct word (match of the splitting pattern) becomes rows (word, position,
token). A recursive query joins neighbours to the merge table and contracts each
word's leftmost pair of least rank, until no pair merges. Between steps the tokens
of a word are packed in one row, in order of position, with the rank of each pair;
a step joins only the two pairs that the last contraction made, which costs a
fiftieth of joining all rows again. Ordered aggregation packs a word, and another,
over the vocabulary, decodes its ids to bytes.

A step costs a word's length, so a word without a break (base64, unspaced script)
would cost its square. It is cut into overlapping segments instead, which the same
query encodes side by side. Token lists whose neighbours all stand side by side in
the encoding of some text are the encoding of their own text, so where two segments
share a whole token they are joined at it, exactly (Coder._joined).

Words are encoded once for each worker and kept in a store bounded by bytes
(STORE_BYTES). It has two halves: when the newer one is full it becomes the older one,
whose words go unless they are met again, so that frequent words stay; forgetting
costs time only. What a worker keeps between partitions is that store and the merge
table, nothing that grows. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import give_back, kept_by_workers, pieces
from .mixing import ORDER, placed

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bytes of words, ids and decoded bytes in the store of one worker.
STORE_BYTES = 160 << 20
BATCH_BYTES = 2 << 20
#: Bytes of a segment of a long word, and of its overlap with the next.
SEGMENT, OVERLAP = 512, 128
#: Rows (word, position, token) that one recursive query starts from.
QUERY_ROWS = 1 << 19

#: A rank above all others: the pair does not merge.
NONE = 1 << 30

_ENCODE = f"""
WITH RECURSIVE pairs AS (
  SELECT w, p, id, (id << 20) | lead(id) OVER (ORDER BY w, p) AS pair FROM first_rows
), t(w, ids, ranks) AS (
  SELECT w, list(id ORDER BY p), list(coalesce(merged, {NONE}) ORDER BY p)[1:count(*) - 1]
  FROM pairs LEFT JOIN merges USING (pair) GROUP BY w
  UNION ALL
  SELECT w,
    flatten([ids[1:i - 1], [best], ids[i + 2:]]),
    flatten([ranks[1:greatest(i - 2, 0)], CASE WHEN i > 1 THEN [coalesce(a.merged, {NONE})] ELSE [] END,
             CASE WHEN i < len(ranks) THEN [coalesce(b.merged, {NONE})] ELSE [] END, ranks[i + 2:]])
  FROM (
    SELECT w, ids, ranks, best, i, (ids[i - 1] << 20) | best AS before, (best << 20) | ids[i + 2] AS after
    FROM (SELECT *, list_position(ranks, best) AS i FROM (SELECT *, list_min(ranks) AS best FROM t) WHERE best < {NONE})
  )
  LEFT JOIN merges AS a ON before = a.pair
  LEFT JOIN merges AS b ON after = b.pair
)
SELECT w, ids FROM t WHERE len(ranks) = 0 OR list_min(ranks) >= {NONE}
"""

_CODED = pa.schema([("w", pa.int64()), ("ids", pa.list_(pa.int64()))])

_DECODE = """
SELECT w, unhex(string_agg(hex(v.bytes), '' ORDER BY p)) AS bytes
FROM (SELECT w, unnest(ids) AS id, generate_subscripts(ids, 1) AS p FROM coded) JOIN vocabulary AS v USING (id)
GROUP BY w
"""


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Coder:
    """Encodes words of one worker; path: the vocabulary file, pattern: the splitting pattern."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.rank = ranks(path)
        self.find = regex.compile(pattern).findall
        self.byte = np.array([self.rank[bytes([i])] for i in range(256)], np.int64)
        pair, merged = [], []
        for token, rank in self.rank.items():
            for i in range(1, len(token)):
                a, b = self.rank.get(token[:i]), self.rank.get(token[i:])
                if a is not None and b is not None:
                    pair.append(a << 20 | b)
                    merged.append(rank)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "256MB", "temp_directory": ""})
        merges = pa.table({"pair": pa.array(pair, pa.int64()), "merged": pa.array(merged, pa.int64())})
        words = pa.table({"id": pa.array(list(self.rank.values()), pa.int64()), "bytes": pa.array(list(self.rank), pa.binary())})
        for name, rows in (("merges", merges), ("vocabulary", words)):
            self.db.register("source_rows", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM source_rows")
            self.db.unregister("source_rows")
        self.crossing = regex.compile(r"\s\s|^\s|\s$").search
        # Ids and decoded bytes by word, of each half of the store.
        self.ids: dict[str, bytes] = {}
        self.text: dict[str, bytes] = {}
        self.old_ids: dict[str, bytes] = {}
        self.old_text: dict[str, bytes] = {}
        self.held = 0
        self.size = {v: len(k) for k, v in self.rank.items()}

    def close(self) -> None:
        for some in (self.ids, self.text, self.old_ids, self.old_text):
            some.clear()
        self.db.close()

    def _put(self, word: str, ids: bytes, text: bytes) -> None:
        self.ids[word], self.text[word] = ids, text
        self.held += 200 + 2 * len(ids) + 2 * len(text)

    def _unknown(self, words: set[str]) -> set[str]:
        """Those not in the store; those of its older half move to the newer one."""
        new = words.difference(self.ids)
        again = new.intersection(self.old_ids)
        for w in again:
            self._put(w, self.old_ids.pop(w), self.old_text.pop(w))
        return new - again

    def _coded(self, parts: list[bytes], names: list[int]) -> list[pa.Table]:
        """(w, ids) of each part by the recursive query; names: its w."""
        out, at = [], 0
        while at < len(parts):
            end, rows = at, 0
            while end < len(parts) and (end == at or rows + len(parts[end]) <= QUERY_ROWS):
                rows += len(parts[end])
                end += 1
            sizes = np.array([len(d) for d in parts[at:end]])
            flat = np.frombuffer(b"".join(parts[at:end]), np.uint8)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            self.db.register("first_rows", pa.table({"w": np.repeat(np.array(names[at:end]), sizes), "p": place, "id": self.byte[flat]}))
            out.append(self.db.sql(_ENCODE).to_arrow_table().cast(_CODED))
            self.db.unregister("first_rows")
            at = end
        return out

    def _lists(self, parts: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in parts]
        for some in self._coded(parts, list(range(len(parts)))):
            for w, ids in zip(some["w"].to_pylist(), some["ids"].to_pylist(), strict=True):
                out[w] = ids
        return out

    def _borders(self, start: int, ids: list[int]) -> list[int]:
        """Where each token begins, and a last end."""
        return list(accumulate((self.size[i] for i in ids), initial=start))

    def _joined(self, data: bytes) -> list[int]:
        """The ids of a long word: those of its segments, joined at tokens that two of them share.

        A merge across the border of two tokens depends on nothing but these two until
        it happens, so a list is the encoding of its text exactly if each pair of
        neighbours is that of its own. Segments give pairs of which that holds, and a
        shared token keeps it at the joint. Where two segments share no token, the next
        one starts anew at a border of the first; if that is no help, both become one.
        """
        step = SEGMENT - OVERLAP
        starts = list(range(0, max(1, len(data) - OVERLAP), step))
        found = self._lists([data[a : a + SEGMENT] for a in starts])
        out, begin = list(found[0]), self._borders(0, found[0])
        for start, ids in zip(starts[1:], found[1:], strict=True):
            back = 0
            while True:
                first = bisect_left(begin, start)
                mine = {ab: first + i for i, ab in enumerate(pairwise(begin[first:]))}
                ends = self._borders(start, ids)
                shared = next(((mine[ab], j) for j, ab in enumerate(pairwise(ends)) if ab in mine), None)
                if shared:
                    del out[shared[0] :], begin[shared[0] :]
                    out += ids[shared[1] :]
                    begin += ends[shared[1] :]
                    break
                if start == 0:  # the whole text so far
                    out, begin = ids, ends
                    break
                stop = ends[-1]
                start = begin[bisect_left(begin, start - back)]
                ids = self._lists([data[start:stop]])[0]
                back = 2 * back + SEGMENT
        return out

    def _solve(self, words: list[str]) -> None:
        """Put ids and decoded bytes of new words into the store."""
        data = [w.encode() for w in words]
        ids = np.array([self.rank.get(d, -1) for d in data], np.int64)
        coded = [pa.table({"w": pa.array(np.flatnonzero(ids >= 0)), "ids": pa.array([[x] for x in ids[ids >= 0].tolist()], pa.list_(pa.int64()))})]
        todo = np.flatnonzero(ids < 0).tolist()
        short = [i for i in todo if len(data[i]) <= SEGMENT]
        coded += self._coded([data[i] for i in short], short)
        if long := [i for i in todo if len(data[i]) > SEGMENT]:
            coded.append(pa.table({"w": pa.array(long), "ids": pa.array([self._joined(data[i]) for i in long], pa.list_(pa.int64()))}))
        for some in coded:
            self.db.register("coded", some)
            out = self.db.sql(_DECODE).to_arrow_table()
            self.db.unregister("coded")
            text = dict(zip(out["w"].to_pylist(), out["bytes"].to_pylist(), strict=True))
            lists = some["ids"].combine_chunks()
            flat = lists.flatten().to_numpy().astype("<u4").tobytes()
            bounds = (4 * np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])).tolist()
            for w, a, b in zip(some["w"].to_pylist(), bounds, bounds[1:], strict=False):
                self._put(words[w], flat[a:b], text[w])

    def _learn(self, units: set[str]) -> None:
        """Words are pieces too, so one store holds both."""
        split = list(zip(units, self._words(units), strict=True))
        self._solve(sorted(self._unknown({w for _, words in split for w in words})))
        for u, words in split:
            if len(words) > 1:
                self._put(u, b"".join(map(self.ids.__getitem__, words)), b"".join(map(self.text.__getitem__, words)))

    def _words(self, units: set[str]) -> Iterator[list[str]]:
        """The matches in each unit. Units with a space in front, and no other, are matched as one text: see split()."""
        plain = [u for u in units if u[:1] == " " and len(u) > 1 and not self.crossing(u[1:])]
        matches = self.find("".join(plain))
        ends, last = (np.cumsum(np.fromiter(map(len, x), np.int64, len(x))) for x in (matches, plain))
        cut = np.searchsorted(ends, last)
        if len(ends) < len(plain) or not np.array_equal(ends[np.minimum(cut, len(ends) - 1)], last):  # a pattern that leaves something out
            return map(self.find, units)
        of = {u: matches[a:b] for u, a, b in zip(plain, [0, *(cut + 1).tolist()], (cut + 1).tolist(), strict=False)}
        return (of[u] if u in of else self.find(u) for u in units)

    def split(self, text: str) -> list[str]:
        """Pieces between which no match of the pattern lies.

        A space between two other characters always begins a match, so pieces may
        be cut before it; a text with longer white space is cut into its matches.
        """
        if self.crossing(text):
            return self.find(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]] if first or rest else []

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """Ids as little-endian unsigned 32-bit integers and the bytes they decode to, for each text."""
        if 2 * self.held > STORE_BYTES:
            self.old_ids, self.old_text, self.ids, self.text = self.ids, self.text, {}, {}
            self.held = 0
        split = [self.split(x) for x in texts]
        if new := self._unknown(set().union(*split)):
            self._learn(new)
        ids, text = self.ids.__getitem__, self.text.__getitem__
        for units in split:
            yield b"".join(map(ids, units)), b"".join(map(text, units))


@lru_cache(1)
def coder(path: str, pattern: str) -> Coder:
    return Coder(path, pattern)


kept_by_workers["coder"] = coder.cache_clear


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(docs: DataFrame, path: str | None = None, pattern: str | None = None, ids: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (little-endian unsigned 32-bit).

    Null text is empty: no tokens. Repeated rows give equal results; columns
    named in keep follow unchanged, others are not read. path: the ranks file, which
    every executor must have in place (default: the installed vocabulary of many languages).
    """
    import public_tokenizers

    path, pattern = path or vocabulary_path(), pattern or public_tokenizers.PATTERN
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = coder(path, pattern)
        gc.disable()  # the store holds many small objects without cycles
        try:
            for whole in batches:
                for batch in pieces(whole, "text", BATCH_BYTES):
                    texts = [x or "" for x in batch.column(1).to_pylist()]
                    rows = [(len(a) // 4, hashlib.sha256(a).hexdigest(), hashlib.sha256(b).hexdigest(), a if ids else None) for a, b in tool.encode(texts)]
                    names, types = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"], [None, pa.int64(), pa.string(), pa.string(), pa.binary()]
                    columns = [batch.column(0)] + [pa.array([r[i] for r in rows], t) for i, t in enumerate(types[1:])]
                    n = 5 if ids else 4
                    yield pa.RecordBatch.from_arrays(columns[:n] + batch.columns[2:], names=names[:n] + list(keep))
        finally:
            gc.enable()
            give_back()

    kept = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select("doc_id", "text", *keep).mapInArrow(run, f"doc_id {key}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids + kept)


def op4(docs: DataFrame) -> DataFrame:
    return encoded(docs)


def stage(docs: DataFrame) -> DataFrame:
    """The last stage: the tokens of each document, and its place in the mix.

    Null and empty texts have no tokens; repeated rows are encoded each, with places of
    their own; extra columns go.
    """
    keep = [c for c in ("doc_id", "text", "source", "n_chars") if c in docs.columns]
    return encoded(placed(docs.select(*keep)), ids=True, keep=ORDER)
