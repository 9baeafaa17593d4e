"""Reads behind the serving calls: latest values, partitions, histories, feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from floodlens.functions.risk import LEVELS
from floodlens.operators import latest
from floodlens.plans import views as v
from floodlens.plans.registry import query
from floodlens.schemas import TOPIC_SOURCES

DOMAINS = {"risk_level": LEVELS}
_SNAP = (v.ZONES_SQL, v.SNAPSHOTS_SQL)
_COLS = "computed_at, risk_score, risk_level, rain_mm, tide_m, flow_m3s"


def _last(c: str) -> str:
    return f"arg_max({c}, computed_at) FILTER (WHERE {c} IS NOT NULL) AS {c}"


@query("latest_risk_by_zone", v.with_sql(*_SNAP, body=f"""
    , newest AS (SELECT * FROM snapshots WHERE date = (SELECT max(date) FROM snapshots)),
    vals AS (SELECT zone_id, {_last('rain_mm')}, {_last('tide_m')}, {_last('flow_m3s')}, {_last('risk_score')},
                    {_last('risk_level')}, max(computed_at) AS computed_at FROM newest GROUP BY zone_id)
    SELECT vals.zone_id, z.sector_name, z.lat, z.lon, rain_mm, tide_m, flow_m3s, risk_score, risk_level, computed_at,
           (SELECT max(computed_at) FROM newest) AS updated_at
    FROM vals LEFT JOIN zones z ON z.zone_id = vals.zone_id"""))
def latest_risk_by_zone(spark, sf):
    rows = latest.latest_risk(v.landed_snapshots(spark, sf), v.zones(spark, sf), DOMAINS)
    return rows.withColumns({c: v.ntz(c) for c in ("computed_at", "updated_at")})


@query("latest_nonnull_by_key", v.with_sql(*_SNAP, body=f"""
    SELECT zone_id, {_last('rain_mm')}, {_last('tide_m')}, {_last('flow_m3s')}, {_last('risk_score')},
           {_last('risk_level')}, max(computed_at) AS computed_at
    FROM snapshots GROUP BY zone_id"""))
def latest_nonnull_by_key(spark, sf):
    columns = ["rain_mm", "tide_m", "flow_m3s", "risk_score", "risk_level", "computed_at"]
    rows = latest.latest_nonnull_by_key(v.snapshots(spark, sf), "zone_id", "computed_at", columns, DOMAINS)
    return rows.withColumn("computed_at", v.ntz("computed_at"))


@query("latest_row_by_key", v.with_sql(*_SNAP, body=f"""
    SELECT zone_id, {_COLS} FROM (
      SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY computed_at DESC) AS rn FROM snapshots) WHERE rn = 1"""))
def latest_row_by_key(spark, sf):
    columns = [c.strip() for c in _COLS.split(",")]
    rows = latest.latest_by_key(v.snapshots(spark, sf), ["zone_id"], "computed_at", [], columns)
    return rows.withColumn("computed_at", v.ntz("computed_at"))


@query("zone_history", v.with_sql(*_SNAP, body=f"""
    SELECT zone_id, {_COLS} FROM snapshots WHERE date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'"""))
def zone_history(spark, sf):
    rows = latest.zone_history(v.snapshots(spark, sf), start="1996-01-01", end="2000-12-31")
    return rows.withColumn("computed_at", v.ntz("computed_at"))


@query("zone_history_one", v.with_sql(*_SNAP, body=f"SELECT {_COLS} FROM snapshots WHERE zone_id = 'Z7'"))
def zone_history_one(spark, sf):
    """The serving call itself: one zone, all dates."""
    return latest.zone_history(v.snapshots(spark, sf), "Z7").withColumn("computed_at", v.ntz("computed_at"))


@query("history_series", v.with_sql(*_SNAP, body="""
    SELECT zone_id, computed_at, round(coalesce(risk_score, 0e0) * 100e0, 4) AS index_pct,
           coalesce(tide_m, 0e0) AS tide_m, coalesce(rain_mm, 0e0) AS rain_mm FROM snapshots"""))
def history_series(spark, sf):
    rows = latest.history_series(latest.zone_history(v.snapshots(spark, sf)))
    return rows.withColumns({"computed_at": v.ntz("computed_at"), "index_pct": F.round("index_pct", 4)})


@query("latest_partition_scan", v.with_sql(*_SNAP, body=f"""
    SELECT zone_id, sector_name, lat, lon, {_COLS} FROM snapshots WHERE date = (SELECT max(date) FROM snapshots)"""))
def latest_partition_scan(spark, sf):
    rows = latest.latest_partition(v.landed_snapshots(spark, sf), "date")
    return rows.withColumn("computed_at", v.ntz("computed_at"))


@query("partition_range_scan", v.with_sql(v.RAW_SQL, body="""
    SELECT source, json_str, kafka_timestamp, date FROM raw
    WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'"""))
def partition_range_scan(spark, sf):
    """Raw table written by source and date, then read for a closed range of dates."""
    rows = latest.partition_range(v.landed_raw(spark, sf), "date", "2024-01-05", "2024-01-20")
    return rows.select("source", "json_str", v.ntz("kafka_timestamp").alias("kafka_timestamp"), "date")


@query("recent_alerts", v.with_sql(v.RAW_SQL, body="""
    SELECT json_str, kafka_timestamp FROM raw WHERE source = 'sngr_alertas'
    ORDER BY kafka_timestamp DESC, json_str DESC LIMIT 20"""))
def recent_alerts(spark, sf):
    return latest.recent_alerts(v.landed_raw(spark, sf)).withColumn("kafka_timestamp", v.ntz("kafka_timestamp"))


@query("source_status", v.with_sql(v.RAW_SQL, body="""
    SELECT s.source, count(raw.event_id) = 0 AS is_empty, count(raw.event_id) AS n_records, count(DISTINCT raw.date) AS n_days, max(raw.date) AS newest_day
    FROM (SELECT unnest(['gee', 'noaa', 'open_meteo', 'nasa_power', 'openweathermap', 'enso_indexes', 'copernicus', 'inamhi', 'sgr_eventos', 'seguraep',
                         'guayas_osm', 'celec_embalse', 'inocar_mareas', 'sngr_alertas', 'ndbc_buoys']) AS source) s
    LEFT JOIN raw ON raw.source = s.source GROUP BY s.source"""))
def source_status(spark, sf):
    """What every source of the map has landed; most have nothing."""
    return latest.source_status(v.landed_raw(spark, sf), sorted(TOPIC_SOURCES.values()))
