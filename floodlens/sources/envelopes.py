"""Record envelopes: JSON text with an ingestion stamp and an optional key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodlens.functions.scalars import iso_utc


def to_envelope(records: DataFrame, as_of: Column, key: Column | None = None) -> DataFrame:
    """``key, value`` records ready for a topic; ``ingested_at`` is added only where missing."""
    stamp = iso_utc(as_of)
    if "ingested_at" in records.columns:
        stamp = F.coalesce(F.col("ingested_at"), stamp)
    fields = [F.col(c) for c in records.columns if c != "ingested_at"]
    body = F.to_json(F.struct(*fields, stamp.alias("ingested_at")), {"ignoreNullFields": "false"})
    return records.select(
        (key if key is not None else F.lit(None)).cast("string").alias("key"), body.cast("binary").alias("value")
    )


def from_envelope(records: DataFrame, schema: str) -> DataFrame:
    """Typed fields of envelope records, with the key."""
    text = F.col("value").cast("string")
    return records.select("key", F.from_json(text, schema).alias("r")).select("key", "r.*")


def write_topic(envelopes: DataFrame, topic: str, bootstrap: str | None = None, path: str | None = None) -> None:
    """Send envelopes to a broker topic, or append them as topic files."""
    if bootstrap is not None:
        envelopes.write.format("kafka").option("kafka.bootstrap.servers", bootstrap).option("topic", topic).save()
        return
    envelopes.select(
        F.lit(topic).alias("topic"), "key", F.col("value").cast("string").alias("value"),
        F.current_timestamp().alias("timestamp"),
    ).write.mode("append").parquet(path)
