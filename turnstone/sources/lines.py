"""Lines of files or texts with exact byte offsets.

Splitting is an Arrow kernel that finds the newlines of a text's bytes once: offsets
come out exact for any encoding, in time that grows with the bytes alone, and nothing
is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession

#: Lines of one batch that goes back to Spark.
ROWS = 1 << 14


def line_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each line, without its newline; blank lines count, a last empty one doesn't."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    if len(data) and (not len(ends) or ends[-1] != len(data) - 1):
        ends = np.append(ends, len(data))
    return np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends, ends


def _batches(data: bytes) -> Iterator[list[pa.Array]]:
    """line_no, byte_offset, line in batches; bytes that are no UTF-8 become replacement characters."""
    starts, ends = line_spans(data)
    for a in range(0, len(starts), ROWS):
        s, e = starts[a : a + ROWS], ends[a : a + ROWS]
        yield [pa.array(np.arange(a, a + len(s)) + 1, pa.int64()), pa.array(s, pa.int64()), pa.array([data[i:j].decode("utf-8", "replace") for i, j in zip(s, e, strict=True)], pa.string())]


def split_lines(df: DataFrame, key: list[str], text: Column) -> DataFrame:
    """key, line_no (from 1), byte_offset, line: split at newlines only; blank lines stay, a last empty one doesn't. Null gives none."""
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*key, "line_no", "byte_offset", "line"]
        for batch in batches:
            for i, body in enumerate(batch.column(len(key)).to_pylist()):
                for columns in _batches((body or "").encode()):
                    pick = pa.array(np.full(len(columns[0]), i))
                    yield pa.RecordBatch.from_arrays([*[batch.column(j).take(pick) for j in range(len(key))], *columns], names=names)

    return df.select(*key, text.alias("text_")).mapInArrow(run, schema + ", line_no bigint, byte_offset bigint, line string")


def decompressed(path: str, data: bytes) -> bytes:
    if not path.lower().endswith(".zst"):
        return data
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(data)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """run_id (the file), line_no, byte_offset, line of files of up to 2 GB; those named .zst are decompressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for columns in _batches(decompressed(name, data.as_py())):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(columns[0]), pa.string()), *columns], names=["run_id", "line_no", "byte_offset", "line"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, "run_id string, line_no bigint, byte_offset bigint, line string")


def read_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files that may be one JSON document: an array gives a line for each element, an object one, anything else its lines."""
    import json

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = decompressed(name, data.as_py())
                try:
                    whole = json.loads(body)
                except (ValueError, RecursionError):
                    whole = None
                if isinstance(whole, (list, dict)):
                    elements = whole if isinstance(whole, list) else [whole]
                    body = "\n".join(json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in elements).encode()
                for columns in _batches(body):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(columns[0]), pa.string()), *columns], names=["run_id", "line_no", "byte_offset", "line"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, "run_id string, line_no bigint, byte_offset bigint, line string")
