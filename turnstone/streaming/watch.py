"""Following a growing folder of event records with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def watch(spark: SparkSession, path: str, schema: str, checkpoint: str, write: Callable[[DataFrame, int], None], once: bool = False, files: int = 1000) -> StreamingQuery:
    """JSON records of new files, at most so many files a batch; offsets live in the checkpoint.

    Later results change earlier nodes, so write gets each batch and should put its
    nodes by key rather than append them. once: drain what is there and end.
    """
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)
    query = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return query.trigger(availableNow=True).start() if once else query.trigger(processingTime="200 milliseconds").start()
