"""Zone dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodlens.functions.scalars import parse_flag
from floodlens.schemas import ZONE_COLUMNS, ZONE_FILE_SCHEMA


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """Zone file with header under an explicit schema; a malformed row fails the read."""
    rows = spark.read.csv(path, header=True, schema=ZONE_FILE_SCHEMA, mode="FAILFAST", encoding="UTF-8")
    named = rows.select(*[F.col(old).alias(new) for old, new in ZONE_COLUMNS.items()])
    return named.withColumn("flood_history", parse_flag("flood_history"))


def write_zones(zones: DataFrame, path: str) -> None:
    """Write a zone file in the layout :func:`read_zones` reads."""
    named = zones.select(*[F.col(new).alias(old) for old, new in ZONE_COLUMNS.items()])
    named.write.mode("overwrite").csv(path, header=True, encoding="UTF-8")
