"""Two-constituent harmonic tide."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodlens.functions.scalars import ColumnLike, as_col, round_exact

# Words of the tide record.
RISING, FALLING = "subiendo", "bajando"
ORIGIN_TABLE, ORIGIN_MODEL = "INOCAR_pdf", "modelo_armonico_fallback"


@dataclass(frozen=True)
class TideModel:
    """Mean level, amplitudes (m) and periods (h); fixed values unless overridden."""

    mean_m: float = 1.8
    lunar_m: float = 1.4
    solar_m: float = 0.4
    lunar_h: float = 12.42
    solar_h: float = 12.0
    high_above_mean_m: float = 1.0
    digits: int = 3


DEFAULT_MODEL = TideModel()


def hours_since_epoch(ts: ColumnLike) -> Column:
    return F.unix_micros(as_col(ts).cast("timestamp")) / F.lit(3.6e9)


def _wave(hours: Column, amplitude: float, period: float) -> Column:
    return F.lit(amplitude) * F.sin(F.lit(2.0 * math.pi) * hours / F.lit(period))


def harmonic_height(ts: ColumnLike, model: TideModel = DEFAULT_MODEL, hours_ahead: float = 0.0) -> Column:
    hours = hours_since_epoch(ts) + F.lit(hours_ahead)
    return F.lit(model.mean_m) + _wave(hours, model.lunar_m, model.lunar_h) + _wave(hours, model.solar_m, model.solar_h)


def with_harmonic_tide(df: DataFrame, ts: str, into: str, model: TideModel = DEFAULT_MODEL) -> DataFrame:
    """Add a struct of rounded height, trend one hour ahead and the high-tide flag."""
    heights = df.withColumns({"__now": harmonic_height(ts, model), "__later": harmonic_height(ts, model, 1.0)})
    now, later = F.col("__now"), F.col("__later")
    tide = F.struct(
        round_exact(now, model.digits).alias("height_m"),
        F.when(later > now, F.lit(RISING)).otherwise(F.lit(FALLING)).alias("trend"),
        (now >= F.lit(model.mean_m + model.high_above_mean_m)).alias("high_tide"),
    )
    return heights.select(*df.columns, tide.alias(into))
