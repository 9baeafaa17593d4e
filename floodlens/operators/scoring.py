"""Current conditions, zone scoring, what-if scenarios and the city gauge."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodlens.functions.risk import DEFAULT_PARAMS, RISK_COLUMNS, RiskParams, with_risk
from floodlens.functions.scalars import gauge_class, json_double, percent_label
from floodlens.operators.latest import latest_payload


@dataclass(frozen=True)
class Reading:
    """Where one scoring input comes from: source, JSON paths in order, value when absent."""

    name: str
    source: str
    paths: tuple[str, ...]
    default: float


# Sources, paths and defaults of the three scoring inputs.
READINGS = (
    Reading("rain_mm", "inamhi", ("$.pronostico_diario.pronostico[0].precipitacion_mm",), 0.0),
    Reading("tide_m", "inocar_mareas", ("$.altura_marea_m", "$.data.mareas.pleamar.altura_m"), 1.8),
    Reading("flow_m3s", "celec_embalse", ("$.caudal_m3s", "$.nivel_msnm"), 100.0),
)
# The narrower paths under which tide always falls back to its default.
LITERAL_READINGS = (
    READINGS[0],
    Reading("tide_m", "inocar_mareas", ("$.data.mareas.pleamar.altura_m",), 1.8),
    Reading("flow_m3s", "celec_embalse", ("$.nivel_msnm",), 100.0),
)


def reading_value(json: Column | str, source: Column | str, readings: Sequence[Reading] = READINGS) -> Column:
    """Number a payload contributes, chosen by its source; NULL when the field is missing."""
    source = F.col(source) if isinstance(source, str) else source
    expr = None
    for r in readings:
        value = json_double(json, r.paths)
        expr = F.when(source == r.source, value) if expr is None else expr.when(source == r.source, value)
    return expr


def reading_default(source: Column | str, readings: Sequence[Reading] = READINGS) -> Column:
    source = F.col(source) if isinstance(source, str) else source
    expr = None
    for r in readings:
        expr = F.when(source == r.source, F.lit(r.default)) if expr is None else expr.when(
            source == r.source, F.lit(r.default)
        )
    return expr


def conditions_from_latest(latest: DataFrame, readings: Sequence[Reading] = READINGS) -> DataFrame:
    """One row of inputs from a table with at most one payload per source.

    Gaps become defaults and are flagged; read failures are not swallowed.
    """
    found = [
        F.max(F.when(F.col("source") == r.source, json_double("json_str", r.paths))).alias(r.name) for r in readings
    ]
    row = latest.agg(*found, F.max("kafka_timestamp").alias("as_of"))
    return row.select(
        *[F.coalesce(F.col(r.name), F.lit(r.default)).alias(r.name) for r in readings],
        *[F.col(r.name).isNull().alias(f"{r.name}_is_default") for r in readings],
        "as_of",
    )


def current_conditions(raw: DataFrame, readings: Sequence[Reading] = READINGS) -> DataFrame:
    """One row: the newest reading of each scoring source."""
    return conditions_from_latest(latest_payload(raw, [r.source for r in readings]), readings)


def score_zones(zones: DataFrame, conditions: DataFrame, params: RiskParams = DEFAULT_PARAMS) -> DataFrame:
    """Score every zone under the one-row ``conditions``.

    The row enters as a scalar subquery, so the zone scan is neither joined nor shuffled.
    """
    now = conditions.select(F.struct("*")).scalar()
    return with_risk(zones.withColumn("__now", now).select("*", "__now.*"), params).select(
        "zone_id", "sector_name", "lat", "lon", "rain_mm", "tide_m", "flow_m3s", "risk_score", "risk_level", "as_of"
    )


@dataclass(frozen=True)
class Scenario:
    name: str
    rain_mm: float
    tide_m: float
    flow_m3s: float

    def __post_init__(self) -> None:
        for field in ("rain_mm", "tide_m", "flow_m3s"):
            value = getattr(self, field)
            if value is None or not value >= 0:
                raise ValueError(f"{field} must be zero or more")


# The dashboard's extreme preset.
EXTREME = Scenario("extreme", 150.0, 5.0, 1500.0)


def simulate(zones: DataFrame, scenarios: Sequence[Scenario], params: RiskParams = DEFAULT_PARAMS) -> DataFrame:
    """Score every zone under every what-if scenario, with components.

    Scenarios are call parameters, so they are unrolled inside the zone scan instead of joined.
    """
    literals = F.array(*[
        F.struct(
            F.lit(s.name).alias("scenario"),
            F.lit(float(s.rain_mm)).alias("rain_mm"),
            F.lit(float(s.tide_m)).alias("tide_m"),
            F.lit(float(s.flow_m3s)).alias("flow_m3s"),
        )
        for s in scenarios
    ])
    return with_risk(zones.select("*", F.inline(literals)), params).select(
        "scenario", "zone_id", "sector_name", "lat", "lon", "rain_mm", "tide_m", "flow_m3s", *RISK_COLUMNS
    )


def validate_scenarios(scenarios: DataFrame) -> DataFrame:
    """Flag each scenario row and name its first bad parameter; NULL is bad too."""
    bad = F.coalesce(*[
        F.when(~F.coalesce(F.col(c) >= 0, F.lit(False)), F.lit(c)) for c in ("rain_mm", "tide_m", "flow_m3s")
    ])
    return scenarios.withColumn("rejected_for", bad).withColumn("is_valid", F.col("rejected_for").isNull())


def split_scenarios(scenarios: DataFrame) -> tuple[DataFrame, DataFrame]:
    checked = validate_scenarios(scenarios)
    return checked.where("is_valid"), checked.where("NOT is_valid")


def city_gauge(scored: DataFrame, by: Sequence[str], score: str = "risk_score") -> DataFrame:
    """Mean index in percent per group; zones without a score count as zero."""
    mean = F.avg(F.coalesce(F.col(score), F.lit(0.0)) * F.lit(100.0))
    return (
        scored.groupBy(*by)
        .agg(F.round(mean, 6).alias("index_pct"), F.count(F.lit(1)).alias("n_zones"))
        .withColumn("gauge", gauge_class("index_pct"))
        .withColumn("label", percent_label(by[0], "index_pct"))
    )
