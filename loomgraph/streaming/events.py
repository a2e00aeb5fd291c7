"""Streaming forms of the two stream-like behaviours: deduplicated events and resumable micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def deduplicated(events: DataFrame, keys: list[str], at: str = "ts", late: str | None = None) -> DataFrame:
    """First event of each key; on a stream, with a bound on lateness the state is bounded too."""
    if events.isStreaming and late:
        return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def microbatches(source: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, failed: Callable[[int, Exception], None] | None = None) -> StreamingQuery:
    """Runs `work` on what is new and appends it; each batch is written under its own number, so a batch that runs again replaces itself.

    A failed batch is reported and skipped if `failed` is given.
    """

    def one(batch: DataFrame, n: int) -> None:
        try:
            work(batch).write.mode("overwrite").parquet(f"{out}/batch={n}")
        except Exception as e:
            if failed is None:
                raise
            failed(n, e)

    return source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
