"""Media columns: signature sniffing.

An Aho-Corasick automaton locates magic bytes; a validator for each format confirms
structure and lengths, so a magic that stands by chance in other data is dropped.
Confirmed media at offset 0 correct the declared type; those further in are carved.

Validators look for marks ahead through Ahead, which remembers the last place found,
so that many magics before one mark, or before none, cost one pass over the data.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, fields, pieces, stored

BLOCK = 64
RATE = 8000
OTHER = "application/octet-stream"


def to_wav(data: bytes) -> tuple[bytes, bytes]:
    """The payload (data and zeros up to a positive multiple of 64) and a WAV file of it: 8-bit, one channel."""
    payload = data + bytes((-len(data)) % BLOCK or (0 if data else BLOCK))
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return payload, head + payload


class Ahead:
    """data.find(mark, at) for offsets that mostly grow."""

    def __init__(self, data: bytes):
        self.data, self.seen = data, {}

    def find(self, mark: bytes, at: int) -> int:
        asked, place = self.seen.get(mark, (-1, -1))
        if asked < 0 or at < asked or 0 <= place < at:
            place = self.data.find(mark, at)
            self.seen[mark] = at, place
        return place


# Validators: (data, offset, marks ahead) -> length of the confirmed medium, or 0.


def _wav(d: bytes, at: int, ahead: Ahead) -> int:
    if len(d) < at + 12 or d[at + 8 : at + 12] != b"WAVE":
        return 0
    end = at + 8 + int.from_bytes(d[at + 4 : at + 8], "little")
    if end > len(d):
        return 0
    i, seen = at + 12, set()
    while i + 8 <= end:
        size = int.from_bytes(d[i + 4 : i + 8], "little")
        seen.add(d[i : i + 4])
        i += 8 + size + size % 2
        if i - size % 2 > end:
            return 0
    return end - at if {b"fmt ", b"data"} <= seen else 0


def _png(d: bytes, at: int, ahead: Ahead) -> int:
    i, first = at + 8, True
    while i + 12 <= len(d):
        size, kind = int.from_bytes(d[i : i + 4], "big"), d[i + 4 : i + 8]
        end = i + 12 + size
        if end > len(d) or first != (kind == b"IHDR") or zlib.crc32(d[i + 4 : end - 4]) != int.from_bytes(d[end - 4 : end], "big"):
            return 0
        if kind == b"IEND":
            return end - at
        i, first = end, False
    return 0


def _bmp(d: bytes, at: int, ahead: Ahead) -> int:
    if len(d) < at + 26:
        return 0
    size, zero, start, info = struct.unpack_from("<IIII", d, at + 2)
    return size if zero == 0 and info in (12, 40, 52, 56, 108, 124) and 14 + info <= start <= size <= len(d) - at else 0


def _gif(d: bytes, at: int, ahead: Ahead) -> int:
    if len(d) < at + 13:
        return 0
    flags = d[at + 10]
    i = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
    while i < len(d):
        mark = d[i]
        if mark == 0x3B:
            return i + 1 - at
        if mark == 0x2C:
            if i + 10 > len(d):
                return 0
            flags = d[i + 9]
            i += 10 + (3 << (flags & 7) + 1 if flags & 0x80 else 0) + 1
        elif mark == 0x21:
            i += 2
        else:
            return 0
        while i < len(d) and d[i]:
            i += d[i] + 1
        i += 1
    return 0


def _jpeg(d: bytes, at: int, ahead: Ahead) -> int:
    i = at + 2
    while i + 4 <= len(d) and d[i] == 0xFF and 0xC0 <= d[i + 1] <= 0xFE:
        kind, size = d[i + 1], int.from_bytes(d[i + 2 : i + 4], "big")
        if size < 2:
            return 0
        i += 2 + size
        if kind == 0xDA:
            end = ahead.find(b"\xff\xd9", i)
            return end + 2 - at if end >= 0 else 0
    return 0


def _gzip(d: bytes, at: int, ahead: Ahead) -> int:
    if len(d) < at + 18 or d[at + 3] & 0xE0:
        return 0
    tool = zlib.decompressobj(31)
    i = at
    try:
        while not tool.eof and i < len(d):
            tool.decompress(d[i : i + 65536], 1 << 20)
            while tool.unconsumed_tail:
                tool.decompress(tool.unconsumed_tail, 1 << 20)
            i += 65536
    except zlib.error:
        return 0
    return min(i, len(d)) - len(tool.unused_data) - at if tool.eof else 0


def _pdf(d: bytes, at: int, ahead: Ahead) -> int:
    if len(d) < at + 8 or not (d[at + 5 : at + 6].isdigit() and d[at + 6 : at + 7] == b"." and d[at + 7 : at + 8].isdigit()):
        return 0
    end = ahead.find(b"%%EOF", at)
    return end + 5 - at if end >= 0 and 0 <= ahead.find(b"startxref", at) < end else 0


FORMATS = (
    (b"RIFF", "audio/wav", _wav),
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"BM", "image/bmp", _bmp),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"%PDF-", "application/pdf", _pdf),
)


def automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for i, (magic, _, _) in enumerate(FORMATS):
        out.add_word(magic.decode("latin-1"), (i, len(magic)))
    out.make_automaton()
    return out


def sniff(data: bytes, tool) -> list[tuple[int, int, str]]:
    """(offset, length, type) of each confirmed medium; what lies inside another is reported too."""
    out, ahead = [], Ahead(data)
    for end, (i, n) in tool.iter(data.decode("latin-1")):
        _, kind, valid = FORMATS[i]
        at = end + 1 - n
        if size := valid(data, at, ahead):
            out.append((at, size, kind))
    return sorted(out)


def typed(data: bytes, tool) -> tuple[str, list[tuple[int, int, str]]]:
    """The type that the bytes show (OTHER, if none is confirmed), and the media carved further in."""
    found = sniff(data, tool)
    own = next((kind for at, _, kind in found if at == 0), OTHER)
    return own, [f for f in found if f[0]]


def sniffed(df: DataFrame, key: str, media: str, declared: str) -> DataFrame:
    """One row per medium found: key, declared, type, offset, length, carved (null for the row's own medium).

    The row's own medium is the one at offset 0; its type corrects the declared one.
    A row where nothing is confirmed there, or whose bytes are null, gives one row with
    type "application/octet-stream" and length of the bytes (0 for null). Repeated rows
    give their media each; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = automaton()
        for whole in batches:
            for batch in pieces(whole, "media"):
                rows = []
                for k, d, said in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    found = sniff(d or b"", tool)
                    if not found or found[0][0]:
                        rows.append((k, said, OTHER, 0, len(d or b""), None))
                    rows += [(k, said, kind, at, size, None if at == 0 else d[at : at + size]) for at, size, kind in found]
                types = [batch.schema.field(0).type, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[key, "declared", "type", "offset", "length", "carved"])

    return df.select(column(key).alias("k"), column(media).alias("media"), column(declared).alias("said")).mapInArrow(run, fields(df, [key]) + ", declared string, type string, offset long, length long, carved binary")


def stored_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each whole text as a WAV file; null is empty, repeated rows give equal files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                data = [(x or "").encode() for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array([to_wav(x)[1] for x in data], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, fields(docs, ["doc_id"]) + ", n_bytes long, media binary")


def digests(media: DataFrame, declared: str = OTHER) -> DataFrame:
    """Sniff stored media, read the payload of the confirmed WAV file and describe it.

    declared: the type that the store claims; the feature says what the bytes made of it,
    how many media were carved from the payload, and the sum and peak of the samples.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = automaton()
        for whole in batches:
            for batch in pieces(whole, "media"):
                rows = []
                for k, n, d in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    own, carved = typed(d, tool)
                    if own != "audio/wav":
                        raise ValueError(f"the stored form of {k} was not confirmed")
                    i = 12
                    while d[i : i + 4] != b"data":
                        i += 8 + int.from_bytes(d[i + 4 : i + 8], "little")
                    payload = d[i + 8 : i + 8 + int.from_bytes(d[i + 4 : i + 8], "little")]
                    feature = f"{declared}>{own};u8;1ch;{RATE}Hz;carved={len(carved)};sum={sum(payload)};peak={max(payload)}"
                    rows.append((k, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(d), hashlib.sha256(d).hexdigest(), feature))
                types = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, fields(media, ["doc_id"]) + ", n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op2(docs: DataFrame) -> DataFrame:
    """Write each text as a WAV file to a stored table, read it from there, sniff and describe it.

    Null texts are empty (64 zeros), repeated rows give equal values, an empty table none.
    The hashes and sums are of what was read back.
    """
    return digests(stored(stored_texts(docs), "media"))
