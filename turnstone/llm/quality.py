"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Words are runs of letters, runs of digits and single other characters. Their uni- to
trigrams are hashed to 2**18 weights; so are the uni- to trigrams of their shapes
(case and length class), which tell something of words never seen.

Training reads a bounded sample: TRAIN_DOCS labelled rows, TRAIN_CHARS characters of
each. Scoring is a sparse dot product over whole texts in one narrow pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, pieces
from .kernels import Spans, U, mix, text_bytes

BITS = 18
TRAIN_DOCS = 6000
TRAIN_CHARS = 20_000
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 0.02, 0.5, 3
THRESHOLD = 0.3
ORDERS = 3

_KIND = np.zeros(256, np.uint8)  # 0 space, 1 lower letter, 2 upper letter, 3 digit, 4 other
_KIND[:] = 4
_KIND[[0x20, 9, 10, 11, 12, 13]] = 0
_KIND[97:123] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[128:] = 1
#: The second byte of capital letters with accents in two-byte UTF-8 (U+00C0 to U+00DE) follows 0xC3.
_ACCENT_UPPER = np.zeros(256, bool)
_ACCENT_UPPER[0x80:0x9F] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all rows, and each row's bounds in them."""
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, np.int64)
    upper = lead[_ACCENT_UPPER[data[lead + 1]]]
    kind[upper] = 2
    kind[upper + 1] = 2
    group = np.where(kind == 2, 1, kind)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = group > 0
    begin[1:] &= (group[1:] != group[:-1]) | (group[1:] == 4) | edge[1:-1]
    start = np.flatnonzero(begin)
    finish = group > 0
    finish[:-1] &= (group[1:] != group[:-1]) | (group[:-1] == 4) | edge[1:-1]
    end = np.flatnonzero(finish) + 1
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    size = end - start
    caps = np.concatenate([[0], np.cumsum(kind == 2)])
    n_caps = caps[end] - caps[start]
    case = np.where(n_caps == 0, 0, np.where(n_caps == size, 3, np.where(kind[start] == 2, 1, 2)))
    whole = Spans(data).hash(start, end)
    shape = mix((np.minimum(size, 24) // 4 * 64 + case * 8 + group[start]).astype(U) + U(1 << 32))
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    grams, rows = [], []
    for token in (whole, shape):
        acc = token
        grams.append(mix(acc))
        rows.append(row)
        for n in range(1, ORDERS):
            acc = mix(acc[:-1] * U(0x9E3779B97F4A7C15) + token[n:])
            same = row[n:] == row[:-n]
            grams.append(acc[same] ^ U(n))
            rows.append(row[n:][same])
    bucket, row = (np.concatenate(grams) >> U(64 - BITS)).astype(np.int64), np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return bucket[order], np.searchsorted(row[order], np.arange(len(offsets)))


def train(texts: list[str], labels: list[int]) -> tuple[np.ndarray, float]:
    """Weights and bias. FTRL-proximal with a step size for each weight; no rows: zeros."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bz = bn = 0.0
    rows = []
    for text, y in zip(texts, labels, strict=True):
        b, _ = features(*text_bytes(pa.array([text], pa.string())))
        idx, count = np.unique(b, return_counts=True)
        rows.append((idx, count / max(1, len(b)) ** 0.5 if len(b) else count.astype(float), y))

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    def bias():
        return -bz / ((BETA + bn**0.5) / ALPHA)

    for _ in range(EPOCHS):
        for idx, x, y in rows:
            w = weights(idx)
            b = bias()
            e = 1 / (1 + np.exp(-np.clip(b + w @ x, -30, 30))) - y
            g = e * x
            z[idx] += g - (np.sqrt(n[idx] + g * g) - np.sqrt(n[idx])) / ALPHA * w
            n[idx] += g * g
            bz += e - ((bn + e * e) ** 0.5 - bn**0.5) / ALPHA * b
            bn += e * e
    return weights(np.arange(1 << BITS)), bias()


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """From at most TRAIN_DOCS labelled rows that are not held out, of least hash of doc_id.

    A doc_id that is labelled both ways counts as 1; null and other labels and null texts
    take no part. No labels: zero weights, so that every score is one half.
    """
    y = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("y"))
    chosen = y.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    # At most TRAIN_DOCS rows of two numbers: bounded, so the texts are not shuffled.
    sample = docs.where(F.col("text").isNotNull()).select("doc_id", F.substring("text", 1, TRAIN_CHARS).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "text").take(TRAIN_DOCS)
    return train([r.text for r in rows], [r.y for r in rows])


def score(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """doc_id and score of each row: 0 to 1, higher where label 1 is likelier.

    Null and empty texts have no n-grams and get the score of the bias alone.
    Repeated rows give equal results; other columns are not read.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    packed = weights.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                bucket, first = features(*text_bytes(batch.column(1)))
                sums = np.concatenate([[0.0], np.cumsum(packed[bucket], dtype=np.float64)])
                count = np.diff(first)
                logit = bias + (sums[first[1:]] - sums[first[:-1]]) / np.sqrt(np.maximum(1, count))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30))))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, score double")


def op6(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs, *fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
