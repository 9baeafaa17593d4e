"""Stateful stream operators. Each also runs unchanged on a batch DataFrame."""

from __future__ import annotations

import threading
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery


def rain_24h(readings: DataFrame, key: str, ts: str, value: str, lateness: str = "2 hours") -> DataFrame:
    """Rain accumulated over 24 hours, every hour, per ``key``.

    Readings collapse into hours first (map-side, then once per hour); only those hourly sums are
    copied into the 24 windows they belong to, instead of every reading 24 times.
    """
    hourly = (
        readings.withWatermark(ts, lateness)
        .groupBy(F.col(key), F.window(ts, "1 hour").alias("hour"))
        .agg(F.sum(value).alias("__sum"), F.count(value).alias("__n"))
    )
    return (
        hourly.groupBy(F.col(key), F.window(F.window_time("hour"), "24 hours", "1 hour").alias("span"))
        .agg(F.sum("__sum").alias("rain_24h_mm"), F.sum("__n").alias("n_readings"))
        .select(key, F.col("span.start").alias("window_start"), F.col("span.end").alias("window_end"),
                "rain_24h_mm", "n_readings")
    )


def drop_retries(stream: DataFrame, keys: Sequence[str], ts: str, lateness: str = "2 hours") -> DataFrame:
    """Keep one of the records a producer sent more than once within the watermark."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(list(keys))


def latest_by_source(raw: DataFrame) -> DataFrame:
    """Newest payload per source; in a stream, run it in update mode."""
    newest = F.max_by("json_str", F.struct("kafka_timestamp", "json_str"))
    return raw.groupBy("source").agg(
        F.max("kafka_timestamp").alias("kafka_timestamp"), newest.alias("json_str")
    )


def start_with_run(writer: DataStreamWriter, write: Callable[[DataFrame, int, str], None]) -> StreamingQuery:
    """Start a stream whose ``write`` also gets the run: the query's id, which stays with its checkpoint."""
    started = threading.Event()
    run: list[str] = []

    def tick(batch: DataFrame, epoch_id: int) -> None:
        started.wait()
        write(batch, epoch_id, run[0])

    query = writer.foreachBatch(tick).start()
    run.append(str(query.id))
    started.set()
    return query


def upsert_by_epoch(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write each epoch's changed rows to a partition of their own; a repeated epoch replaces itself.

    Partitions are by run and epoch, so a new checkpoint leaves the rows of earlier ones alone.
    """

    def write(batch: DataFrame, epoch_id: int, run_id: str) -> None:
        (
            batch.withColumn("run_id", F.lit(run_id)).withColumn("epoch_id", F.lit(epoch_id).cast("long"))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("run_id", "epoch_id").parquet(path)
        )

    writer = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return start_with_run(writer.trigger(availableNow=True) if once else writer.trigger(processingTime="60 seconds"), write)
