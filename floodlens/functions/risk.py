"""Composite flood-risk index as a chain of column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodlens.functions.scalars import ColumnLike, as_col, clip01, pin, round_exact, threshold_class

# Level names in ascending order of risk.
LEVELS = ("bajo", "medio", "alto", "critico")


@dataclass(frozen=True)
class RiskParams:
    """Thresholds and weights of the index (fixed values unless the caller overrides them)."""

    rain_saturation_mm: float = 150.0
    tide_low_m: float = 0.4
    tide_high_m: float = 3.6
    reservoir_limit: float = 85.0
    weight_rain: float = 0.35
    weight_tide: float = 0.15
    weight_reservoir: float = 0.15
    weight_ground: float = 0.20
    weight_history: float = 0.15
    rain_tide_interaction: float = 0.25
    elevation_span_m: float = 20.0
    channel_span_m: float = 1000.0
    ground_elevation: float = 0.5
    ground_slope: float = 0.3
    ground_channel: float = 0.2
    slope_factors: dict[str, float] = field(
        default_factory=lambda: {"plana": 1.0, "suave": 0.6, "moderada": 0.3, "pronunciada": 0.1}
    )
    slope_other: float = 0.5
    level_cuts: tuple[float, float, float] = (0.25, 0.5, 0.75)
    digits: int = 4


DEFAULT_PARAMS = RiskParams()


def rain_norm(mm: ColumnLike, p: RiskParams = DEFAULT_PARAMS) -> Column:
    return clip01(as_col(mm) / F.lit(p.rain_saturation_mm))


def tide_norm(m: ColumnLike, p: RiskParams = DEFAULT_PARAMS) -> Column:
    return clip01((as_col(m) - F.lit(p.tide_low_m)) / F.lit(p.tide_high_m - p.tide_low_m))


def reservoir_norm(flow: ColumnLike, p: RiskParams = DEFAULT_PARAMS) -> Column:
    return clip01(as_col(flow) / F.lit(p.reservoir_limit))


def slope_factor(slope: ColumnLike, p: RiskParams = DEFAULT_PARAMS) -> Column:
    """Factor of a slope class; an unknown or missing class gets the middle value."""
    slope = as_col(slope)
    expr = None
    for name, factor in p.slope_factors.items():
        hit = slope == F.lit(name)
        expr = F.when(hit, F.lit(factor)) if expr is None else expr.when(hit, F.lit(factor))
    return expr.otherwise(F.lit(p.slope_other)) if expr is not None else F.lit(p.slope_other)


def low_ground_norm(elevation_m: ColumnLike, p: RiskParams = DEFAULT_PARAMS) -> Column:
    return clip01(F.lit(1.0) - as_col(elevation_m) / F.lit(p.elevation_span_m))


def near_channel_norm(channel_m: ColumnLike, p: RiskParams = DEFAULT_PARAMS) -> Column:
    return clip01(F.lit(1.0) - as_col(channel_m) / F.lit(p.channel_span_m))


def history_norm(flag: ColumnLike) -> Column:
    """A missing flag counts as never flooded."""
    return F.when(as_col(flag), F.lit(1.0)).otherwise(F.lit(0.0))


def risk_level(score: ColumnLike, p: RiskParams = DEFAULT_PARAMS) -> Column:
    """Level of the unrounded score."""
    return threshold_class(score, p.level_cuts, LEVELS)


RISK_COLUMNS = (
    "risk_score", "risk_level", "rain_norm", "tide_norm", "reservoir_norm", "ground_norm", "history_norm",
    "rain_tide_interaction",
)


def with_risk(df: DataFrame, p: RiskParams = DEFAULT_PARAMS) -> DataFrame:
    """Add :data:`RISK_COLUMNS` to rows holding the weather inputs and the zone attributes.

    Needs ``rain_mm, tide_m, flow_m3s, elevation_m, slope_class, channel_m, flood_history``. A
    missing number gives a NULL score and level; it never turns into a full score. The index is
    built in steps so that each intermediate value is computed once: one nested expression would
    repeat its parts in every clip and every rounding.
    """
    parts = df.withColumns({
        "rain_norm": rain_norm("rain_mm", p),
        "tide_norm": tide_norm("tide_m", p),
        "reservoir_norm": reservoir_norm("flow_m3s", p),
        "history_norm": history_norm("flood_history"),
        "__low": low_ground_norm("elevation_m", p),
        "__near": near_channel_norm("channel_m", p),
        "__slope": slope_factor("slope_class", p),
    })
    ground = parts.withColumn(
        "__ground",
        F.lit(p.ground_elevation) * F.col("__low")
        + F.lit(p.ground_slope) * F.col("__slope")
        + F.lit(p.ground_channel) * F.col("__near"),
    ).withColumn("ground_norm", clip01("__ground"))
    summed = ground.withColumn(
        "rain_tide_interaction", F.lit(p.rain_tide_interaction) * F.col("rain_norm") * F.col("tide_norm")
    ).withColumn(
        "__sum",
        F.lit(p.weight_rain) * F.col("rain_norm")
        + F.lit(p.weight_tide) * F.col("tide_norm")
        + F.lit(p.weight_reservoir) * F.col("reservoir_norm")
        + F.lit(p.weight_ground) * F.col("ground_norm")
        + F.lit(p.weight_history) * F.col("history_norm")
        + F.col("rain_tide_interaction"),
    ).withColumn("__score", clip01("__sum"))
    rounded = ("rain_norm", "tide_norm", "reservoir_norm", "ground_norm", "rain_tide_interaction")
    return pin(
        summed, df.columns,
        risk_score=round_exact("__score", p.digits),
        risk_level=risk_level("__score", p),
        **{c: round_exact(c, p.digits) if c in rounded else F.col(c) for c in RISK_COLUMNS[2:]},
    )
