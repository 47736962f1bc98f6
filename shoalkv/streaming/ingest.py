"""Streaming ingest: micro-batches of mutations, published exactly once.

A micro-batch is at least once: after a crash Spark repeats it with the same rows. Its publish is idempotent by the
LSN watermark (which marks durable progress, and has nothing to do with event time). A source must deliver LSNs in
ranges that rise from batch to batch, as a log's files do; within a batch, order doesn't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..plans.flush import Flushed, publish
from ..schema import MUTATION
from ..sources.lake import Lake


def publishing(lake: Lake, seen: list[Flushed] | None = None, files: int | None = None):
    """The body of foreachBatch."""

    def body(batch: DataFrame, number: int) -> None:
        done = publish(lake, batch.select(*MUTATION.names), files=files)
        if seen is not None:
            seen.append(done)

    return body


def ingest(stream: DataFrame, lake: Lake, checkpoint: str, seen: list[Flushed] | None = None, files: int | None = None) -> StreamingQuery:
    """Publish all that is available now; how much a micro-batch takes is the source's option (``maxFilesPerTrigger``)."""
    return stream.writeStream.foreachBatch(publishing(lake, seen, files)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserted(stream: DataFrame) -> DataFrame:
    """Keyed state: the last mutation per key by LSN, late and repeated ones included (output mode ``update``)."""
    last = F.max_by(F.struct("op", "value"), "lsn").alias("last")
    return stream.groupBy("pk").agg(F.max("lsn").alias("lsn"), last).select("pk", "lsn", F.col("last.op").alias("op"), F.col("last.value").alias("value"))
