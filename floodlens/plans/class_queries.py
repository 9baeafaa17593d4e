"""Threshold classes and station filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from floodlens.functions import scalars as sc
from floodlens.plans import views as v
from floodlens.plans.registry import query


@query("anomaly_class", """
    SELECT l_orderkey, l_linenumber, a AS anomaly,
           CASE WHEN a >= 1.5e0 THEN 'hot' WHEN a >= 0.5e0 THEN 'warm' WHEN a >= -0.5e0 THEN 'neutral' ELSE 'cool' END AS class4,
           CASE WHEN a >= 1.5e0 THEN 'hot' WHEN a >= 0.5e0 THEN 'warm' WHEN a >= -0.5e0 THEN 'neutral' WHEN a >= -1.5e0 THEN 'cool' ELSE 'cold' END AS class5,
           CASE WHEN a > 0 THEN '+' ELSE '' END || printf('%.2f', a) || ' °C' AS label
    FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 0e0 ELSE (l_quantity - 25e0) / 10e0 END AS a FROM lineitem)""")
def anomaly_class(spark, sf):
    measured = F.when(F.col("l_returnflag") != "R", (F.col("l_quantity") - 25.0) / 10.0)
    rows = v.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", sc.number_or_zero(measured).alias("anomaly"))
    return rows.select(
        "*", sc.anomaly_class4("anomaly").alias("class4"), sc.anomaly_class5("anomaly").alias("class5"),
        sc.signed_label("anomaly", "°C").alias("label"),
    )


@query("threshold_alerts", """
    SELECT event_id, coalesce(x, 0e0) / 100e0 > 2.5e0 AS tide_alert, coalesce(x, 0e0) > 80 AS reservoir_alert,
           CASE WHEN x IS NULL THEN NULL WHEN x >= 8 THEN 'high' WHEN x >= 5 THEN 'moderate' ELSE 'low' END AS uv
    FROM (SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS x FROM events)""")
def threshold_alerts(spark, sf):
    rows = v.table(spark, sf, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("x"))
    return rows.select(
        "event_id", sc.tide_alert(F.col("x") / 100.0).alias("tide_alert"),
        sc.reservoir_alert("x").alias("reservoir_alert"), sc.uv_class("x").alias("uv"),
    )


@query("elevation_class", v.with_sql(v.ZONES_SQL, body="""
    SELECT zone_id, e AS elevation_m, CASE WHEN e < 2 THEN 'Alto / Crítico' WHEN e < 5 THEN 'Medio' ELSE 'Bajo' END AS risk,
           greatest(e, 0e0) < 5 AS evacuate
    FROM (SELECT zone_id, elevation_m - 3e0 AS e FROM zones)"""))
def elevation_class(spark, sf):
    rows = v.zones(spark, sf).select("zone_id", (F.col("elevation_m") - 3.0).alias("elevation_m"))
    return rows.select(
        "*", sc.elevation_risk("elevation_m").alias("risk"), sc.evacuation_offered("elevation_m").alias("evacuate")
    )


_SEGMENTS = ("BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD")


@query("active_stations", f"""
    SELECT c_custkey AS station_id, c_mktsegment AS canton, (c_custkey % 100)::DOUBLE AS altitude_m, c_custkey % 2 = 0 AS is_weather
    FROM customer WHERE c_nationkey < 12 AND c_mktsegment IN {_SEGMENTS}""")
def active_stations(spark, sf):
    """Transmitting stations of the chosen cantons, with the weather-category flag."""
    rows = v.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("station_id"), F.col("c_mktsegment").alias("canton"),
        (F.col("c_custkey") % 100).cast("double").alias("altitude_m"),
        F.when(F.col("c_nationkey") < 12, "TRANSMITIENDO").otherwise("SIN SEÑAL").alias("status"),
        F.when(F.col("c_custkey") % 2 == 0, "METEOROLÓGICA").otherwise("HIDROLÓGICA").alias("category"),
    )
    active = rows.where((F.col("status") == "TRANSMITIENDO") & F.col("canton").isin(list(_SEGMENTS)))
    return active.select("station_id", "canton", "altitude_m", F.contains("category", F.lit("METEORO")).alias("is_weather"))
