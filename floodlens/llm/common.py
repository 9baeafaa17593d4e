"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from floodlens.session import ensure_checkpoint_dir, shared_dir, ship_package


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's checkpoint folder and go on from there, so that a lost executor costs no earlier step."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def cut_table(df: DataFrame) -> DataFrame:
    """The same through a Parquet table in the shared folder, which takes less room for many narrow rows."""
    path = shared_dir(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_arrow(df: DataFrame, compute: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with the package at hand in the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(compute, schema)


_held: dict[Any, Any] = {}


def held(key: Any, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept by this Python worker until it needs something of another key.

    Spark hands workers on from stage to stage; what one stage remembered is let go when the next one begins.
    """
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]
