"""GeoJSON layers as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodlens.operators.features import explode_features


def write_layers(features: DataFrame, path: str, layer: str = "layer") -> None:
    """One row per feature, one folder per layer; a rewrite replaces what it touches."""
    features.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(layer).json(path)


def read_layers(spark: SparkSession, path: str) -> DataFrame:
    """Feature rows written by :func:`write_layers`."""
    schema = "geometry_type STRING, coordinates STRING, properties MAP<STRING, STRING>, layer STRING"
    return spark.read.schema(schema).json(path)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Feature rows of GeoJSON documents, one document per file, with the file they came from."""
    documents = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("file"), F.col("value").alias("json_str")
    )
    return explode_features(documents, keep=["file"])
