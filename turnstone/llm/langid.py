"""Language identification by compression.

Each language has a raw-content Zstandard dictionary made of its own texts. A text
belongs to the language whose dictionary makes it smallest; where the runner-up is
hardly larger, the text is rejected.

Fitted on a bounded sample: SAMPLE_DOCS documents and DICT_BYTES bytes for each of the
MAX_LANGS languages with most rows (rarer ones are not learned). Prediction is one
narrow pass over whole texts. Every text, of whatever length, is compressed as COPIES
of itself: what the first copy finds in the dictionary then counts beside the fixed
size of a block (for texts under 200 bytes, one copy is 79 % right, four are 97 %).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, fields, held_out, let_go, pieces

SAMPLE_DOCS = 300
SAMPLE_BYTES = 2000
DICT_BYTES = 96_000
MAX_LANGS = 200
LEVEL = 6
TABLES = {"min_match": 3, "hash_log": 15, "chain_log": 15, "window_log": 18}
COPIES = 4
#: Bytes of difference that make one language e times as likely as another.
TEMPERATURE = 2.0
#: Below this score the margin is narrow and the text is rejected.
MIN_SCORE = 0.3
#: So likely a runner-up, against the winner, is too near, whatever the other languages
#: score: 0 or 1 byte larger. Of 4000 training rows at sf0.1 outside the dictionaries
#: this took 12 of the 20 wrong ones and 16 of the 3980 right ones.
MOST_RUNNER_UP = 0.5
_LETTER = re.compile(r"[^\W\d_]")


def fit(docs: DataFrame) -> dict[str, bytes]:
    """A dictionary for each language, from text and lang of rows that are not held out.

    The sample takes the rows of least hash of doc_id, about SAMPLE_DOCS for each
    language, wherever they lie; rows with null text or lang take no part.
    """
    train = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r.lang: r.n for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").take(MAX_LANGS)}
    if not counts:
        return {}
    # A share of the hash range for each language bounds what is collected.
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, SAMPLE_DOCS / n))).otherwise(share)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    sample = train.where(place < share).select("lang", place.alias("p"), F.substring("text", 1, SAMPLE_BYTES).alias("text"))
    rows = sample.orderBy("p", "lang", "text").take(2 * SAMPLE_DOCS * len(counts) + 100)
    out: dict[str, list[bytes]] = {k: [] for k in counts}
    for r in rows:
        out[r.lang].append(r.text.lower().encode())
    # The most general content stands last, where offsets are short.
    return {k: b"\n".join(v[::-1])[-DICT_BYTES:] for k, v in sorted(out.items()) if v}


def classifier(dictionaries: dict[str, bytes]):
    """A function of one text: language, score, rejected; "und", 0, True for null or without a letter."""
    import zstandard as zstd

    params = zstd.ZstdCompressionParameters.from_level(LEVEL, **TABLES, write_content_size=False, write_checksum=False, write_dict_id=False)
    tools = []
    for lang, content in dictionaries.items():
        d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        tools.append((lang, zstd.ZstdCompressor(dict_data=d, compression_params=params)))

    def classify(text: str | None) -> tuple[str, float, bool]:
        if text is None or not tools or not _LETTER.search(text):
            return "und", 0.0, True
        data = text.lower().encode() * COPIES
        sizes = [(len(tool.compress(data)), lang) for lang, tool in tools]
        least, lang = min(sizes)
        likely = sorted((math.exp((least - n) / TEMPERATURE) for n, _ in sizes), reverse=True)
        score = 1 / sum(likely)
        return lang, score, score < MIN_SCORE or (len(likely) > 1 and likely[1] > MOST_RUNNER_UP)

    return classify


def identify(docs: DataFrame, dictionaries: dict[str, bytes], keep: list[str] | None = None, only_clear: bool = False) -> DataFrame:
    """The columns in keep (default: doc_id) of each row, then lang_pred, score and rejected.

    only_clear: just the columns in keep, of rows that aren't rejected. Null text or
    text without a letter: "und", score 0, rejected. Ties are named after the language
    that sorts first, and rejected. Repeated rows give equal results. Columns may have
    any name; those not in keep are not read.
    """
    keep = keep or ["doc_id"]
    schema = fields(docs, keep) + ("" if only_clear else ", lang_pred string, score double, rejected boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if only_clear:
            let_go()  # the worker may have ended another table's pipeline, whose last stage keeps a store
        classify = classifier(dictionaries)
        for whole in batches:
            for batch in pieces(whole, whole.schema.names[-1]):
                found = [classify(x.as_py()) for x in batch.columns[-1]]
                lang, score, rejected = [[x[i] for x in found] for i in range(3)]
                if only_clear:
                    yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=keep).filter(pa.array([not x for x in rejected], pa.bool_()))
                else:
                    columns = [*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
                    yield pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score", "rejected"])

    return docs.select(*[column(c).alias(f"k{i}") for i, c in enumerate(keep)], column("text").alias("t")).mapInArrow(run, schema)


def op1(docs: DataFrame) -> DataFrame:
    out = identify(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def stage(docs: DataFrame) -> DataFrame:
    """Documents whose language is clear; the others go. Columns stay as they are.

    Null and empty texts go, repeated rows stay or go together, extra columns of any
    name stay; an empty table stays empty.
    """
    return identify(docs, fit(docs), docs.columns, only_clear=True)
