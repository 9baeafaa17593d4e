"""Topic streams: one subscription for all topics, or files standing in for a broker."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floodlens.schemas import TOPIC_SOURCES

TOPIC_FILE_SCHEMA = "topic STRING, key STRING, value STRING, timestamp TIMESTAMP"


# Records of a topic outside the map land under this source, so that no committed offset loses data.
UNMAPPED = "unmapped"

# Records a broker may hand to one micro-batch; without it the first one is the whole history.
MAX_OFFSETS_PER_TRIGGER = 1_000_000


def kafka_options(bootstrap: str, topics: Sequence[str], max_offsets: int = MAX_OFFSETS_PER_TRIGGER) -> dict[str, str]:
    """Every topic in one subscription, from the earliest offset, in bounded batches, tolerating lost offsets."""
    return {
        "maxOffsetsPerTrigger": str(max_offsets),
        "kafka.bootstrap.servers": bootstrap,
        "subscribe": ",".join(topics),
        "startingOffsets": "earliest",
        "failOnDataLoss": "false",
    }


def topic_stream(
    spark: SparkSession,
    topics: Sequence[str] = tuple(TOPIC_SOURCES),
    bootstrap: str | None = None,
    path: str | None = None,
    file_format: str = "parquet",
    max_files_per_trigger: int | None = None,
    max_offsets_per_trigger: int = MAX_OFFSETS_PER_TRIGGER,
    mapping: Mapping[str, str] = TOPIC_SOURCES,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Raw rows of ``topics`` from a broker (``bootstrap``) or from topic files (``path``), with the record's columns ``keep``."""
    if unknown := sorted(set(topics) - set(mapping)):
        raise ValueError(f"no source is known for the topics {unknown}")
    if (bootstrap is None) == (path is None):
        raise ValueError("name either a broker or a folder of topic files")
    if bootstrap is not None:
        stream = spark.readStream.format("kafka").options(**kafka_options(bootstrap, topics, max_offsets_per_trigger)).load()
    else:
        reader = spark.readStream.format(file_format).schema(TOPIC_FILE_SCHEMA)
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
        stream = reader.load(path).where(F.col("topic").isin(list(topics)))
    return to_raw(stream, mapping, keep)


def source_of(topic: Column | str, mapping: Mapping[str, str] = TOPIC_SOURCES) -> Column:
    """Source folder of a topic; NULL for a topic outside the map."""
    topic = F.col(topic) if isinstance(topic, str) else topic
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), topic)


def to_raw(records: DataFrame, mapping: Mapping[str, str] = TOPIC_SOURCES, keep: Sequence[str] = ()) -> DataFrame:
    """Broker records as raw-zone rows: text, broker time, source (``UNMAPPED`` outside the map) and partition date, and ``keep``."""
    return records.select(
        F.col("value").cast("string").alias("json_str"),
        F.col("timestamp").cast("timestamp").alias("kafka_timestamp"),
        F.coalesce(source_of("topic", mapping), F.lit(UNMAPPED)).alias("source"),
        F.to_date(F.col("timestamp").cast("timestamp")).alias("date"),
        *keep,
    )


def union_sources(frames: Mapping[str, DataFrame]) -> DataFrame:
    """UNION ALL by name of per-source frames, each row tagged with its source."""
    tagged = [df.select(F.lit(name).alias("source"), "*") for name, df in frames.items()]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df)
    return out
