"""Incremental ingest: files that arrive are annotated once; a rerun goes on where the last one ended."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def ingest(arriving: DataFrame, annotate: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Write annotate(batch) of all that has arrived under target; returns the running query, which ends by itself.

    Each batch writes a folder of its own, overwritten when the batch is repeated after a failure: no row twice, none lost.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        annotate(batch).write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={batch_id}")

    return arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_arrivals(arriving: DataFrame, content: Sequence[str], at: str, within: str = "1 day") -> DataFrame:
    """One row of each content that comes again within the given time: the others are answered from the label cache."""
    key = F.md5(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}))
    return arriving.withColumns({"content_key": key, at: F.col(at).cast("timestamp")}).withWatermark(at, within).dropDuplicatesWithinWatermark(["content_key"])
