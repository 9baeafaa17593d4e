"""Reductions of gridded measurements over regions and days."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodlens.functions.geometry import OCEAN_REGIONS, Box, in_box, regions_of


def between_days(df: DataFrame, date: str, start=None, end=None) -> DataFrame:
    """Half-open range: from ``start`` up to but not including ``end``."""
    if start is not None:
        df = df.where(F.col(date) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(date) < F.lit(end).cast("date"))
    return df


def first_days(df: DataFrame, date: str, n: int) -> DataFrame:
    """Rows of the ``n`` oldest distinct dates; the last of them bounds the scan."""
    oldest = df.select(date).distinct().orderBy(date).limit(n)
    return df.where(F.col(date) <= oldest.agg(F.max(date)).scalar())


def surface_only(df: DataFrame, depth: str = "depth") -> DataFrame:
    """Cells of the shallowest depth."""
    return df.where(F.col(depth) == df.agg(F.min(depth)).scalar())


def region_daily_mean(
    grid: DataFrame,
    values: Mapping[str, float],
    boxes: Sequence[Box] = OCEAN_REGIONS,
    date: str = "date",
    lat: str = "lat",
    lon: str = "lon",
    start=None,
    end=None,
    n_days: int | None = None,
    digits: int = 6,
) -> DataFrame:
    """Mean per region and day; ``values`` maps a column to the divisor of its stored integers.

    ``n_days`` keeps the first days of the range only.

    A cell finds its regions by comparing with a handful of literal boxes, without a range join,
    and NULL cells are skipped. Averages combine map-side before the one shuffle.
    """
    cells = between_days(grid, date, start, end)
    if n_days is not None:
        cells = first_days(cells, date, n_days)
    members = cells.select(date, *values, F.explode_outer(regions_of(lat, lon, boxes)).alias("region")).where(
        F.col("region").isNotNull()
    )
    means = [F.round(F.avg(c) / F.lit(float(scale)), digits).alias(f"mean_{c}") for c, scale in values.items()]
    return members.groupBy("region", date).agg(*means, F.count(F.lit(1)).alias("n_cells"))


def daily_region_rain(
    half_hours: DataFrame,
    box: Box,
    date: str = "date",
    lat: str = "lat",
    lon: str = "lon",
    rate: str = "rate",
    digits: int = 6,
) -> DataFrame:
    """Rate summed per cell and day, averaged over the cells of ``box``, halved to mm per day."""
    per_cell = (
        half_hours.where(in_box(lat, lon, box)).groupBy(date, lat, lon).agg(F.sum(rate).alias("__day_sum"))
    )
    return per_cell.groupBy(date).agg(F.round(F.avg("__day_sum") / F.lit(2.0), digits).alias("rain_mm"))


def with_daily_rain(days: DataFrame, rain: DataFrame, date: str = "date") -> DataFrame:
    """Every day of ``days`` with its rain, zero when no rain was measured."""
    return days.join(rain, date, "left").withColumn("rain_mm", F.coalesce("rain_mm", F.lit(0.0)))
