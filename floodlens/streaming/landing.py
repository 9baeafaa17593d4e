"""Landing and scoring jobs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from floodlens.functions.risk import DEFAULT_PARAMS, RiskParams
from floodlens.operators.scoring import READINGS, Reading, conditions_from_latest, score_zones
from floodlens.schemas import TOPIC_SOURCES
from floodlens.sources.sinks import write_snapshots
from floodlens.sources.topics import MAX_OFFSETS_PER_TRIGGER, topic_stream
from floodlens.sources.zones import read_zones
from floodlens.streaming.windows import latest_by_source, start_with_run

STATE_SCHEMA = "source STRING, kafka_timestamp TIMESTAMP, json_str STRING"


@dataclass(frozen=True)
class MonitorConfig:
    """Folders and switches of the monitoring job. All folders must be reachable by every executor."""

    base: str
    zones_path: str
    bootstrap: str | None = None
    topic_files: str | None = None
    topics: Sequence[str] = tuple(TOPIC_SOURCES)
    interval: str = "60 seconds"
    max_files_per_trigger: int | None = None
    max_offsets_per_trigger: int = MAX_OFFSETS_PER_TRIGGER
    readings: Sequence[Reading] = READINGS
    params: RiskParams = DEFAULT_PARAMS
    as_of: str | None = None  # fixed stamp for repeatable runs

    @property
    def raw(self) -> str:
        return f"{self.base}/raw"

    @property
    def state(self) -> str:
        return f"{self.base}/state"

    @property
    def snapshots(self) -> str:
        return f"{self.base}/snapshots"

    @property
    def checkpoint(self) -> str:
        return f"{self.base}/_checkpoints/monitor"


def _slot(config: MonitorConfig, run_id: str, epoch_id: int) -> str:
    return f"{config.state}/run_id={run_id}/slot={epoch_id % 2}"


def _state_before(spark: SparkSession, config: MonitorConfig, run_id: str, epoch_id: int) -> DataFrame:
    """Latest readings before an epoch: of the other slot, or of all earlier runs when a checkpoint begins."""
    fields = ["source", "kafka_timestamp", "json_str"]
    if epoch_id > 0:
        return spark.read.schema(STATE_SCHEMA).parquet(_slot(config, run_id, epoch_id - 1)).select(*fields)
    try:
        return spark.read.schema(STATE_SCHEMA).parquet(config.state).select(*fields)
    except AnalysisException:  # no state has been written yet
        return spark.createDataFrame([], STATE_SCHEMA)


def land_and_score(batch: DataFrame, epoch_id: int, zones: DataFrame, config: MonitorConfig, run_id: str = "manual") -> None:
    """One micro-batch: land its rows, renew the latest reading per source, score every zone.

    Landing and scoring share the batch, so a score always sees the records that triggered it.
    Everything a repeated epoch writes replaces what its first attempt wrote: raw rows and
    snapshots by run and epoch, the state by its run's slot. The state holds one row per source and
    is read from the other slot, so neither history nor state grows the work of a tick; the first
    tick of a new checkpoint starts from the state of the runs before it and replaces none of their rows.
    """
    spark = batch.sparkSession
    batch = batch.persist()
    try:
        (
            batch.withColumn("run_id", F.lit(run_id)).withColumn("epoch_id", F.lit(epoch_id).cast("long"))
            .hint("rebalance", "source", "date")  # one file or a few per folder; a hot source is split
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("source", "date", "run_id", "epoch_id").parquet(config.raw)
        )
        sources = sorted({r.source for r in config.readings} | set(TOPIC_SOURCES.values()))
        fields = ["source", "kafka_timestamp", "json_str"]
        fresh = batch.where(F.col("source").isin(sources)).select(*fields)
        before = _state_before(spark, config, run_id, epoch_id)
        newest = latest_by_source(before.unionByName(fresh)).select(*fields)  # one row per source
        newest.coalesce(1).write.mode("overwrite").parquet(_slot(config, run_id, epoch_id))

        state = spark.read.schema(STATE_SCHEMA).parquet(_slot(config, run_id, epoch_id))
        scored = score_zones(zones, conditions_from_latest(state, config.readings), config.params)
        write_snapshots(scored, config.snapshots, epoch_id, config.as_of, run_id)
    finally:
        batch.unpersist()


def start_monitor(spark: SparkSession, config: MonitorConfig, once: bool = False) -> StreamingQuery:
    """Start the one query that lands and scores every topic."""
    stream = topic_stream(
        spark, config.topics, config.bootstrap, config.topic_files,
        max_files_per_trigger=config.max_files_per_trigger, max_offsets_per_trigger=config.max_offsets_per_trigger,
    )
    zones = read_zones(spark, config.zones_path)
    writer = (
        stream.writeStream.queryName("floodlens-monitor")
        .option("checkpointLocation", config.checkpoint).outputMode("append")
    )
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=config.interval)
    return start_with_run(writer, lambda batch, epoch, run: land_and_score(batch, epoch, zones, config, run))


def run_monitor(spark: SparkSession, config: MonitorConfig, once: bool = True) -> None:
    """Run to the end of the available data, or until any query of the session stops or fails."""
    query = start_monitor(spark, config, once)
    if once:
        query.awaitTermination()
    else:
        spark.streams.awaitAnyTermination()
