"""Incremental ingest: documents of a stream, once for each content, through a batch plan into the store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def deduplicated(stream: DataFrame, time: str, within: str = "1 hour") -> DataFrame:
    """The stream's first row for each content; state is bounded by the watermark."""
    x = stream.withColumn("sha256", F.sha2(F.encode("text", "UTF-8"), 256))
    return x.withWatermark(time, within).dropDuplicatesWithinWatermark(["sha256"])


def run(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Applies a batch plan to each micro-batch of what has come and appends its rows to out.

    A batch that is repeated after a failure overwrites its own folder, so results stay once.
    """

    def write(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
