"""What the operators of this package share: tables, folders, held-out rows."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only on a local master whose session names no spark.checkpoint.dir, as in tests.
FALLBACK_DIR = "/tmp/checkpoints"


def column(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fields(df: DataFrame, names: list[str]) -> str:
    """Some columns of df as DDL."""
    return ", ".join("`" + n.replace("`", "``") + "` " + df.schema[n].dataType.simpleString() for n in names)


def unused(df: DataFrame, name: str) -> str:
    """name, or name and a number, such that df has no such column in any case."""
    taken, out, i = {c.lower() for c in df.columns}, name, 0
    while out.lower() in taken:
        i += 1
        out = f"{name}{i}"
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Off a local master it must be set: a folder of one machine would not be shared.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", FALLBACK_DIR)
        named = FALLBACK_DIR
    return named.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there.

    A lost executor then costs the tasks it ran, not all that came before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete every table that stored() wrote for this application."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column) -> Column:
    """True for rows that no model may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


#: How a worker lets go of what an operator keeps in it between tasks.
kept_by_workers: dict[str, Callable[[], None]] = {}


def let_go() -> None:
    """Drop what earlier stages keep in this worker, before a stage that has no use for it."""
    for drop in kept_by_workers.values():
        drop()
    give_back()


def give_back() -> None:
    """Collect what is left and hand free memory back: workers live on for other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def pieces(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most limit bytes in column, or one row."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += int(n)
    if at < batch.num_rows:
        yield batch.slice(at)
