"""Following files that grow, by byte offsets that live in the stream's checkpoint.

The source's offset is the number of bytes taken of each file. A batch takes whole lines
only: what follows the last newline waits. A file that got shorter was written anew and
starts at 0; one that isn't there yet, or no more, gives nothing.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from ..operators import normalize as NZ
from ..sources.discover import EXTENSIONS, find_transcripts, infer_tool

RECORDS = "run_id string, line_no bigint, byte_offset bigint, line string"


class _Piece(InputPartition):
    def __init__(self, path: str, start: int, end: int, lines: int):
        self.path, self.start, self.end, self.lines = path, start, end, lines


def complete_to(path: str, start: int, most: int) -> tuple[int, int]:
    """Where the last whole line from start on ends, within most bytes (or one line), and how many lines that is."""
    end, lines, at = start, 0, start
    with open(path, "rb") as f:
        f.seek(start)
        while chunk := f.read(1 << 20):
            cut = chunk.rfind(b"\n")
            if cut >= 0:
                end = at + cut + 1
                lines += chunk.count(b"\n")
            at += len(chunk)
            if at - start >= most and end > start:
                break
    return end, lines


class TailSource(DataSource):
    """Options: root (a folder) or paths (JSON list), bytes (most of a file in one batch)."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return RECORDS

    def streamReader(self, schema):
        return _TailReader(self.options)


class _TailReader(DataSourceStreamReader):
    def __init__(self, options):
        self.root, self.listed = options.get("root"), json.loads(options.get("paths", "[]"))
        self.most = int(options.get("bytes", 64 << 20))
        self.taken: dict[str, list[int]] = {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def files(self) -> list[str]:
        return sorted({*self.listed, *([f.path for f in find_transcripts(self.root, EXTENSIONS)] if self.root else [])})

    def latestOffset(self) -> dict:
        """For each file: bytes and lines taken so far, and how often it was written anew."""
        now = dict(self.taken)
        for path in self.files():
            at, lines, turn = now.get(path, [0, 0, 0])
            try:
                if os.path.getsize(path) < at:
                    at, lines, turn = 0, 0, turn + 1
                end, more = complete_to(path, at, self.most)
            except FileNotFoundError:
                continue
            now[path] = [end, lines + more, turn]
        self.taken = now
        return {"files": now}

    def partitions(self, start: dict, end: dict) -> list[_Piece]:
        out = []
        self.taken = self.taken or dict(end["files"])
        for path, (stop, _, turn) in sorted(end["files"].items()):
            at, lines, before = start["files"].get(path, [0, 0, 0])
            if turn != before:
                at, lines = 0, 0
            if stop > at:
                out.append(_Piece(path, at, stop, lines))
        return out

    def read(self, partition) -> Iterator[tuple]:
        at, number = partition.start, partition.lines
        try:
            with open(partition.path, "rb") as f:
                f.seek(at)
                for line in f:
                    if at >= partition.end:
                        return
                    number += 1
                    yield partition.path, number, at, line.removesuffix(b"\n").decode("utf-8", "replace")
                    at += len(line)
        except FileNotFoundError:
            return

    def commit(self, end: dict) -> None:
        pass


def tail(spark: SparkSession, root: str | None = None, paths: list[str] | None = None, most: int = 64 << 20) -> DataFrame:
    """A stream of raw records of files under a folder, or of listed ones, new files included."""
    spark.dataSource.register(TailSource)
    source = spark.readStream.format("tail").option("bytes", str(most)).option("paths", json.dumps(paths or []))
    return (source.option("root", root) if root else source).load()


def live(spark: SparkSession, root: str, store: str, checkpoint: str, write: Callable[[DataFrame], None], tools: list[str] | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None, once: bool = False) -> StreamingQuery:
    """Keep the nodes of transcripts under a folder up to date while they grow.

    Each batch adds its records to store (Parquet, a folder for each tool) and prepares the
    files that it touched anew from all their records there: numbers, sessions, repeats and
    calls go on over batches, and a late failure, rewind or compaction changes nodes that
    are out already. write gets these files' nodes and should put them by key. A batch that
    comes again after a failure adds the same records, which count once.
    """
    from ..operators.nodes import prepare as all_steps

    steps = prepare or all_steps
    wanted = set(tools or NZ.NORMALIZERS)

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{store}/in/batch={number}")
        session = df.sparkSession
        new = session.read.schema(RECORDS).parquet(f"{store}/in/batch={number}")
        touched = [r.run_id for r in new.select("run_id").distinct().collect()]  # file names of one batch
        every = session.read.schema(RECORDS + ", batch bigint").parquet(f"{store}/in")
        for tool in sorted({infer_tool(p) for p in touched} & wanted):
            mine = [p for p in touched if infer_tool(p) == tool]
            # A file that was written anew counts from its last start on.
            records = every.where(F.col("run_id").isin(mine))
            begin = records.where("line_no = 1").groupBy("run_id").agg(F.max("batch").alias("begin"))
            records = records.join(begin, "run_id").where("batch >= begin").groupBy("run_id", "line_no").agg(F.max_by(F.struct("byte_offset", "line"), "batch").alias("x")).select("run_id", "line_no", "x.*")
            write(steps(NZ.normalize(records, tool)))

    query = tail(spark, root).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return query.trigger(availableNow=True).start() if once else query.trigger(processingTime="200 milliseconds").start()
