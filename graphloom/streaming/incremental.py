"""Extension: the same functions over streams. Batch by batch for stages, with bounded state for first-seen graphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def by_batch(stream: DataFrame, stage: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Appends what ``stage`` makes of each batch of new documents; one file folder a batch, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        stage(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(stream: DataFrame, keys: list[str], time_col: str, delay: str = "1 day") -> DataFrame:
    """Each key once within the delay, as when graphs are merged; state older than the watermark goes."""
    return stream.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)


def tumbling_counts(stream: DataFrame, time_col: str, key: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """(start, key, n) by windows of event time."""
    rows = stream.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, delay)
    return rows.groupBy(F.window(time_col, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
