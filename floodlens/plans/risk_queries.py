"""Scoring: zones, current conditions, scenarios, gauges."""

from __future__ import annotations

from pyspark.sql import functions as F

from floodlens.operators import latest, scoring
from floodlens.plans import views as v
from floodlens.plans.registry import query
from floodlens.schemas import TOPIC_SOURCES
from floodlens.session import shared_dir
from floodlens.sources.zones import read_zones, write_zones

_R = v.risk_sql("rain_mm", "tide_m", "flow_m3s")
_SCENARIOS_SQL = "scenarios(scenario, rain_mm, tide_m, flow_m3s) AS (VALUES " + ", ".join(
    f"('{s.name}', {s.rain_mm!r}::DOUBLE, {s.tide_m!r}::DOUBLE, {s.flow_m3s!r}::DOUBLE)" for s in v.SCENARIOS
) + ")"
_SIMULATED_SQL = f"""
simulated AS (
  SELECT scenario, zone_id, sector_name, lat, lon, rain_mm, tide_m, flow_m3s,
         CAST(printf('%.4f', {_R['score']}) AS DOUBLE) AS risk_score, {_R['level']} AS risk_level,
         CAST(printf('%.4f', {_R['rain']}) AS DOUBLE) AS rain_norm, CAST(printf('%.4f', {_R['tide']}) AS DOUBLE) AS tide_norm,
         CAST(printf('%.4f', {_R['flow']}) AS DOUBLE) AS reservoir_norm, CAST(printf('%.4f', {_R['ground']}) AS DOUBLE) AS ground_norm,
         {_R['history']} AS history_norm, CAST(printf('%.4f', {_R['inter']}) AS DOUBLE) AS rain_tide_interaction
  FROM zones CROSS JOIN scenarios)"""
_SIM = (v.ZONES_SQL, _SCENARIOS_SQL, _SIMULATED_SQL)


@query("zones_dim", v.with_sql(v.ZONES_SQL, body="SELECT * FROM zones"))
def zones_dim(spark, sf):
    """Zone file written and read back under its explicit schema."""
    path = shared_dir(spark, "zones")
    write_zones(v.zones(spark, sf), path)
    return read_zones(spark, path)


RISK_CURRENT_SQL = v.with_sql(
    v.ZONES_SQL, v.RAW_SQL, v.LATEST_SQL, v.CONDITIONS_SQL,
    body=f"""SELECT zone_id, sector_name, lat, lon, rain_mm, tide_m, flow_m3s,
       CAST(printf('%.4f', {_R['score']}) AS DOUBLE) AS risk_score, {_R['level']} AS risk_level, as_of
       FROM zones CROSS JOIN conditions""",
)


@query("risk_current", RISK_CURRENT_SQL)
def risk_current(spark, sf):
    """Risk now, for every zone, from the newest reading of each source."""
    scored = scoring.score_zones(v.zones(spark, sf), scoring.current_conditions(v.landed_raw(spark, sf)))
    return scored.withColumn("as_of", v.ntz("as_of"))


@query("current_conditions", v.with_sql(
    v.RAW_SQL, v.LATEST_SQL, v.CONDITIONS_SQL, body="SELECT rain_mm, tide_m, flow_m3s, as_of FROM conditions"))
def current_conditions(spark, sf):
    row = scoring.current_conditions(v.landed_raw(spark, sf))
    return row.select("rain_mm", "tide_m", "flow_m3s", v.ntz("as_of").alias("as_of"))


@query("latest_payload_by_source", v.with_sql(
    v.RAW_SQL, v.LATEST_SQL, body="SELECT source, kafka_timestamp, json_str FROM latest"))
def latest_payload_by_source(spark, sf):
    rows = latest.latest_payload(v.landed_raw(spark, sf), sorted(TOPIC_SOURCES.values()))
    return rows.select("source", v.ntz("kafka_timestamp").alias("kafka_timestamp"), "json_str")


@query("latest_payload_unwrapped", v.with_sql(v.RAW_SQL, v.LATEST_SQL, body="""
    SELECT source, coalesce(CAST(json_extract(json_str, '$.data') AS VARCHAR), json_str) AS json_str FROM latest"""))
def latest_payload_unwrapped(spark, sf):
    rows = latest.latest_payload(v.landed_raw(spark, sf), sorted(TOPIC_SOURCES.values()), unwrap=True)
    return rows.select("source", "json_str")


@query("json_scalar_with_default", v.with_sql(v.RAW_SQL, body="""
    SELECT source, kafka_timestamp, coalesce(found, dflt) AS value, found IS NULL AS is_default
    FROM (SELECT source, kafka_timestamp,
                 CASE source WHEN 'inamhi' THEN try_cast(json_extract_string(json_str, '$.pronostico_diario.pronostico[0].precipitacion_mm') AS DOUBLE)
                             WHEN 'inocar_mareas' THEN try_cast(json_extract_string(json_str, '$.altura_marea_m') AS DOUBLE)
                             ELSE try_cast(json_extract_string(json_str, '$.nivel_msnm') AS DOUBLE) END AS found,
                 CASE source WHEN 'inamhi' THEN 0e0 WHEN 'inocar_mareas' THEN 1.8e0 ELSE 100e0 END AS dflt
          FROM raw WHERE source IN ('inamhi', 'inocar_mareas', 'celec_embalse'))"""))
def json_scalar_with_default(spark, sf):
    raw = v.raw(spark, sf).where(F.col("source").isin([r.source for r in scoring.READINGS]))
    found = scoring.reading_value("json_str", "source")
    return raw.select(
        "source", v.ntz("kafka_timestamp").alias("kafka_timestamp"),
        F.coalesce(found, scoring.reading_default("source")).alias("value"), found.isNull().alias("is_default"),
    )


@query("risk_scenarios", v.with_sql(*_SIM, body="""
    SELECT scenario, zone_id, sector_name, lat, lon, rain_mm, tide_m, flow_m3s, risk_score, risk_level FROM simulated"""))
def risk_scenarios(spark, sf):
    return scoring.simulate(v.zones(spark, sf), v.SCENARIOS).select(
        "scenario", "zone_id", "sector_name", "lat", "lon", "rain_mm", "tide_m", "flow_m3s", "risk_score", "risk_level"
    )


@query("risk_components", v.with_sql(*_SIM, body="""
    SELECT scenario, zone_id, rain_norm, tide_norm, reservoir_norm, ground_norm, history_norm, rain_tide_interaction
    FROM simulated"""))
def risk_components(spark, sf):
    return scoring.simulate(v.zones(spark, sf), v.SCENARIOS).select(
        "scenario", "zone_id", "rain_norm", "tide_norm", "reservoir_norm", "ground_norm", "history_norm",
        "rain_tide_interaction",
    )


@query("risk_levels", v.with_sql(*_SIM, body="""
    SELECT scenario, risk_level, count(*) AS n_zones, max(risk_score) AS max_score FROM simulated GROUP BY 1, 2"""))
def risk_levels(spark, sf):
    return scoring.simulate(v.zones(spark, sf), v.SCENARIOS).groupBy("scenario", "risk_level").agg(
        F.count(F.lit(1)).alias("n_zones"), F.max("risk_score").alias("max_score")
    )


@query("citywide_risk", v.with_sql(*_SIM, body="""
    SELECT *, CASE WHEN index_pct <= 40e0 THEN 'Bajo' WHEN index_pct <= 70e0 THEN 'Medio' ELSE 'Alto' END AS gauge,
           scenario || chr(10) || CAST(floor(index_pct + 0.5e0) AS BIGINT) || '%' AS label
    FROM (SELECT scenario, round(avg(coalesce(risk_score, 0e0) * 100e0), 6) AS index_pct, count(*) AS n_zones
          FROM simulated GROUP BY scenario)"""))
def citywide_risk(spark, sf):
    return scoring.city_gauge(scoring.simulate(v.zones(spark, sf), v.SCENARIOS), ["scenario"])


@query("scenario_validate", """
    SELECT s_suppkey, rain_mm, tide_m, flow_m3s,
           CASE WHEN coalesce(rain_mm >= 0, false) = false THEN 'rain_mm' WHEN tide_m < 0 THEN 'tide_m'
                WHEN flow_m3s < 0 THEN 'flow_m3s' END AS rejected_for,
           coalesce(rain_mm >= 0, false) AND tide_m >= 0 AND flow_m3s >= 0 AS is_valid
    FROM (SELECT s_suppkey, CASE WHEN s_nationkey <> 3 THEN s_acctbal / 50e0 END AS rain_mm,
                 (s_suppkey % 6)::DOUBLE AS tide_m, (s_suppkey * 10)::DOUBLE AS flow_m3s FROM supplier)""")
def scenario_validate(spark, sf):
    rows = v.table(spark, sf, "supplier").select(
        "s_suppkey",
        F.when(F.col("s_nationkey") != 3, F.col("s_acctbal") / 50.0).alias("rain_mm"),
        (F.col("s_suppkey") % 6).cast("double").alias("tide_m"),
        (F.col("s_suppkey") * 10).cast("double").alias("flow_m3s"),
    )
    return scoring.validate_scenarios(rows)
