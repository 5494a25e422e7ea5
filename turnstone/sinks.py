"""Where nodes go: NDJSON, a keyed table in SQLite or Parquet, bi-temporal records, memory."""

from __future__ import annotations

import datetime as dt
import os
import sqlite3
import sys
from collections.abc import Callable
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import nodes as N

#: What takes nodes: a function of the relation that nodes.nodes() gives.
Sink = Callable[[DataFrame], None]
BATCH = 1000


def in_order(every: DataFrame) -> DataFrame:
    """One order for all files: by seq, rank and key, as one stream has it."""
    return every.orderBy("seq", "rank", "secondary", "run_id")


def ndjson(path: str) -> Sink:
    """One JSON object a line, in order, over what was there; a folder of part files that together are in order."""
    return lambda every: in_order(every).select(F.col("json").alias("value")).write.mode("overwrite").text(path)


def stream(out: TextIO | None = None) -> Sink:
    """The same to one open file, standard output by default; rows come to the driver a partition at a time."""

    def write(every: DataFrame) -> None:
        to = out or sys.stdout
        for r in in_order(every).select("json").toLocalIterator():
            to.write(r.json + "\n")
        to.flush()

    return write


def sqlite(path: str) -> Sink:
    """Table nodes(pk, node_type, fact_status, json): a key that comes again replaces its row. One file on the driver."""

    def write(every: DataFrame) -> None:
        db = sqlite3.connect(path)
        db.execute("CREATE TABLE IF NOT EXISTS nodes (pk TEXT PRIMARY KEY, node_type TEXT NOT NULL, fact_status TEXT NOT NULL, json TEXT NOT NULL)")
        for column in ("node_type", "fact_status"):
            db.execute(f"CREATE INDEX IF NOT EXISTS nodes_{column} ON nodes({column})")
        held: list[tuple] = []
        for r in N.keyed_rows(every).toLocalIterator():
            held.append(tuple(r))
            if len(held) == BATCH:
                db.executemany("INSERT OR REPLACE INTO nodes VALUES (?, ?, ?, ?)", held)
                held = []
        db.executemany("INSERT OR REPLACE INTO nodes VALUES (?, ?, ?, ?)", held)
        db.commit()
        db.close()

    return write


def count_by_type(path: str) -> dict[str, int]:
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    out = dict(db.execute("SELECT node_type, count(*) FROM nodes GROUP BY 1"))
    db.close()
    return out


def keyed_parquet(path: str) -> Sink:
    """The keyed table at any size: what is there and what comes, the newer row of each key, written beside and then put in place."""

    def write(every: DataFrame) -> None:
        spark = every.sparkSession
        new = N.keyed_rows(every).withColumn("turn", F.lit(1))
        fs = _filesystem(spark, path)
        if fs.exists(_path(spark, path)):
            new = new.unionByName(spark.read.parquet(path).withColumn("turn", F.lit(0)))
        latest = new.groupBy("pk").agg(F.max_by(F.struct("node_type", "fact_status", "json"), "turn").alias("x")).select("pk", "x.*")
        latest.write.mode("overwrite").parquet(path + ".next")
        fs.delete(_path(spark, path), True)
        if not fs.rename(_path(spark, path + ".next"), _path(spark, path)):
            raise OSError(f"could not put {path}.next in place")

    return write


def _path(spark, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _filesystem(spark, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def records(path: str, now: dt.datetime | None = None) -> Sink:
    """Bi-temporal records as Parquet; now: the time of transaction."""
    return lambda every: N.records(every, now or dt.datetime.now(dt.timezone.utc)).write.mode("append").parquet(path)


def memory(into: list) -> Sink:
    """The rows themselves, in order, for tests and small inputs."""
    return lambda every: into.extend(in_order(every).collect())


def build(kind: str, path: str | None) -> Sink:
    """A sink by name: ndjson (to a path, or standard output), sqlite, parquet or records."""
    if kind == "ndjson":
        return stream() if path in (None, "-") else ndjson(path)
    makers = {"sqlite": sqlite, "parquet": keyed_parquet, "records": records}
    if kind not in makers:
        raise ValueError(f"unknown sink {kind!r}")
    if not path:
        raise ValueError(f"the {kind} sink needs a path")
    return makers[kind](os.path.expanduser(path))
