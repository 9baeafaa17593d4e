"""Deterministic input views over the test tables, each in Spark and in SQL.

The SQL side holds the common table expressions the oracles build on. Every view covers its whole
table; what varies by key is only the shape of the derived data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floodlens.functions.risk import with_risk
from floodlens.operators.scoring import Scenario
from floodlens.session import pin_utc, shared_dir
from floodlens.sources.topics import to_raw

EVENT_TOPICS = {
    "view": "mareas-inocar",
    "click": "nivel-embalse-celec",
    "purchase": "inamhi-data",
    "signup": "noaa-data",
    "error": "alertas-sngr",
}
SCENARIOS = (
    Scenario("calm", 0.0, 0.4, 10.0),
    Scenario("showers", 40.0, 1.8, 30.0),
    Scenario("storm", 90.0, 2.7, 70.0),
    Scenario("extreme", 150.0, 5.0, 1500.0),
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return pin_utc(spark).read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def ntz(ts: Column | str) -> Column:
    """Timestamps leave the queries without a zone, as SQL ``TIMESTAMP``."""
    return (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp_ntz")


def lonlat(key: str, lat_span: int = 120, lat_shift: int = 60, lon_step: int = 7) -> tuple[Column, Column]:
    k = F.col(key)
    lat = (k % lat_span - lat_shift).cast("double")
    lon = (k * lon_step % 360 - 180).cast("double")
    return lat, lon


def zones(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    lat, lon = lonlat("c_custkey")
    slopes = F.array(*map(F.lit, ("plana", "suave", "moderada", "pronunciada", "otra")))
    return table(spark, sf, "customer").select(
        F.concat(F.lit("Z"), k.cast("string")).alias("zone_id"),
        F.col("c_name").alias("sector_name"),
        lat.alias("lat"),
        lon.alias("lon"),
        (k % 25).cast("double").alias("elevation_m"),
        F.get(slopes, (k % 5).cast("int")).alias("slope_class"),
        (k % 3 == 0).alias("flood_history"),
        (F.abs("c_acctbal") % 1500.0).alias("channel_m"),
    )


ZONES_SQL = """
zones AS (
  SELECT 'Z' || c_custkey AS zone_id, c_name AS sector_name,
         (c_custkey % 120 - 60)::DOUBLE AS lat, (c_custkey * 7 % 360 - 180)::DOUBLE AS lon,
         (c_custkey % 25)::DOUBLE AS elevation_m,
         ['plana', 'suave', 'moderada', 'pronunciada', 'otra'][c_custkey % 5 + 1] AS slope_class,
         c_custkey % 3 = 0 AS flood_history,
         abs(c_acctbal) % 1500e0 AS channel_m
  FROM customer)"""


def topic_records(events: DataFrame) -> DataFrame:
    """Broker records made from (batch or streaming) events; one in ten payloads lacks its number."""
    plain = F.col("value").cast("decimal(12,2)").cast("string")
    small = (F.col("value") / 100).cast("decimal(12,4)").cast("string")
    has = F.col("event_id") % 10 != 0

    def body(kind: str, full: Column, bare: str) -> tuple[Column, Column]:
        return F.col("event_type") == kind, F.when(has, full).otherwise(F.lit(bare))

    bodies = [
        body("view", F.concat(F.lit('{"altura_marea_m":'), small, F.lit(',"pleamar":false}')), '{"pleamar":false}'),
        body("click", F.concat(F.lit('{"nivel_msnm":'), plain, F.lit(',"embalse":"Daule-Peripa"}')),
             '{"embalse":"Daule-Peripa"}'),
        body("purchase", F.concat(F.lit('{"pronostico_diario":{"pronostico":[{"precipitacion_mm":'), plain, F.lit("}]}}")),
             '{"pronostico_diario":{"error":"timeout"}}'),
        body("signup", F.concat(F.lit('{"metadata":{"source":"sst"},"data":[{"anomaly":'), plain, F.lit("}]}")),
             '{"metadata":{"source":"sst"}}'),
        body("error", F.concat(F.lit('{"severidad":"alta","valor":'), plain, F.lit("}")), '{"severidad":"media"}'),
    ]
    json = F.when(*bodies[0])
    for hit, text in bodies[1:]:
        json = json.when(hit, text)
    pairs = [F.lit(x) for pair in EVENT_TOPICS.items() for x in pair]
    return events.select(
        F.element_at(F.create_map(*pairs), F.col("event_type")).alias("topic"),
        F.col("event_id").cast("string").alias("key"),
        json.alias("value"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


def raw(spark: SparkSession, sf: str) -> DataFrame:
    return to_raw(topic_records(table(spark, sf, "events")))


_landed: dict[tuple[str, str, str], str] = {}


def _landed_table(spark: SparkSession, sf: str, name: str, rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` as a table of files partitioned by ``by``, written once per application and input."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _landed:
        path = shared_dir(spark, f"landed-{name}")
        rows.hint("rebalance", *by).write.partitionBy(*by).parquet(path)
        _landed[key] = path
    return spark.read.parquet(_landed[key])


def landed_raw(spark: SparkSession, sf: str) -> DataFrame:
    """The raw zone as the landing job leaves it: by source and date."""
    return _landed_table(spark, sf, "raw", raw(spark, sf), "source", "date")


def landed_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """The scored snapshots by date."""
    return _landed_table(spark, sf, "snapshots", snapshots(spark, sf), "date")


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a file stream."""
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


RAW_SQL = """
raw AS (
  SELECT event_id, ts AS kafka_timestamp, CAST(ts AS DATE) AS date,
         CASE event_type WHEN 'view' THEN 'inocar_mareas' WHEN 'click' THEN 'celec_embalse'
              WHEN 'purchase' THEN 'inamhi' WHEN 'signup' THEN 'noaa' WHEN 'error' THEN 'sngr_alertas' END AS source,
         CASE event_type
           WHEN 'view' THEN CASE WHEN event_id % 10 <> 0 THEN '{"altura_marea_m":' || CAST(value / 100 AS DECIMAL(12,4)) || ',"pleamar":false}' ELSE '{"pleamar":false}' END
           WHEN 'click' THEN CASE WHEN event_id % 10 <> 0 THEN '{"nivel_msnm":' || CAST(value AS DECIMAL(12,2)) || ',"embalse":"Daule-Peripa"}' ELSE '{"embalse":"Daule-Peripa"}' END
           WHEN 'purchase' THEN CASE WHEN event_id % 10 <> 0 THEN '{"pronostico_diario":{"pronostico":[{"precipitacion_mm":' || CAST(value AS DECIMAL(12,2)) || '}]}}' ELSE '{"pronostico_diario":{"error":"timeout"}}' END
           WHEN 'signup' THEN CASE WHEN event_id % 10 <> 0 THEN '{"metadata":{"source":"sst"},"data":[{"anomaly":' || CAST(value AS DECIMAL(12,2)) || '}]}' ELSE '{"metadata":{"source":"sst"}}' END
           WHEN 'error' THEN CASE WHEN event_id % 10 <> 0 THEN '{"severidad":"alta","valor":' || CAST(value AS DECIMAL(12,2)) || '}' ELSE '{"severidad":"media"}' END
         END AS json_str
  FROM events)"""

# Latest payload per source, and the one row of scoring inputs.
LATEST_SQL = """
latest AS (
  SELECT source, arg_max(json_str, (kafka_timestamp, json_str)) AS json_str, max(kafka_timestamp) AS kafka_timestamp
  FROM raw GROUP BY source)"""
CONDITIONS_SQL = """
conditions AS (
  SELECT coalesce(max(CASE WHEN source = 'inamhi' THEN try_cast(json_extract_string(json_str, '$.pronostico_diario.pronostico[0].precipitacion_mm') AS DOUBLE) END), 0e0) AS rain_mm,
         coalesce(max(CASE WHEN source = 'inocar_mareas' THEN coalesce(try_cast(json_extract_string(json_str, '$.altura_marea_m') AS DOUBLE), try_cast(json_extract_string(json_str, '$.data.mareas.pleamar.altura_m') AS DOUBLE)) END), 1.8e0) AS tide_m,
         coalesce(max(CASE WHEN source = 'celec_embalse' THEN coalesce(try_cast(json_extract_string(json_str, '$.caudal_m3s') AS DOUBLE), try_cast(json_extract_string(json_str, '$.nivel_msnm') AS DOUBLE)) END), 100e0) AS flow_m3s,
         max(kafka_timestamp) FILTER (WHERE source IN ('inamhi', 'inocar_mareas', 'celec_embalse')) AS as_of
  FROM latest)"""


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Scored snapshots: one per order, for the zone of its customer, in quarter-end partitions."""
    orders = table(spark, sf, "orders").select(
        F.concat(F.lit("Z"), F.col("o_custkey").cast("string")).alias("__zone"),
        (F.col("o_totalprice") % 200.0).alias("rain_mm"),
        (F.col("o_orderkey") % 50 / 10.0).alias("tide_m"),
        (F.col("o_totalprice") % 130.0).alias("flow_m3s"),
        (F.col("o_orderstatus") != "P").alias("__scored"),
        F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey")).alias("computed_at"),
        F.last_day(F.add_months(F.trunc("o_orderdate", "quarter"), 2)).alias("date"),
    )
    scored = with_risk(orders.join(zones(spark, sf), F.col("__zone") == F.col("zone_id")))
    return scored.select(
        "zone_id", "sector_name", "lat", "lon", "rain_mm", "tide_m", "flow_m3s",
        F.when(F.col("__scored"), F.col("risk_score")).alias("risk_score"),
        F.when(F.col("__scored"), F.col("risk_level")).alias("risk_level"),
        "computed_at", "date",
    )


def risk_sql(rain: str, tide: str, flow: str) -> dict[str, str]:
    """SQL of the index parts over a row that has the zone columns."""
    c = lambda x: f"CASE WHEN {x} IS NULL THEN NULL ELSE greatest(0e0, least(1e0, {x})) END"
    r, t, f = c(f"({rain} / 150e0)"), c(f"(({tide} - 0.4e0) / (3.6e0 - 0.4e0))"), c(f"({flow} / 85e0)")
    slope = "CASE slope_class WHEN 'plana' THEN 1e0 WHEN 'suave' THEN 0.6e0 WHEN 'moderada' THEN 0.3e0 WHEN 'pronunciada' THEN 0.1e0 ELSE 0.5e0 END"
    low, near = c("(1e0 - elevation_m / 20e0)"), c("(1e0 - channel_m / 1000e0)")
    g = c(f"(0.5e0 * ({low}) + 0.3e0 * ({slope}) + 0.2e0 * ({near}))")
    h = "CASE WHEN flood_history THEN 1e0 ELSE 0e0 END"
    inter = f"(0.25e0 * ({r}) * ({t}))"
    base = f"(0.35e0 * ({r}) + 0.15e0 * ({t}) + 0.15e0 * ({f}) + 0.2e0 * ({g}) + 0.15e0 * ({h}))"
    score = c(f"({base} + {inter})")
    level = f"CASE WHEN ({score}) IS NULL THEN NULL WHEN ({score}) < 0.25e0 THEN 'bajo' WHEN ({score}) < 0.5e0 THEN 'medio' WHEN ({score}) < 0.75e0 THEN 'alto' ELSE 'critico' END"
    return {"rain": r, "tide": t, "flow": f, "ground": g, "history": h, "inter": inter, "score": score, "level": level}


_R = risk_sql("rain_mm", "tide_m", "flow_m3s")
SNAPSHOTS_SQL = f"""
snapshot_inputs AS (
  SELECT z.*, o_totalprice % 200e0 AS rain_mm, (o_orderkey % 50) / 10e0 AS tide_m, o_totalprice % 130e0 AS flow_m3s,
         o_orderstatus <> 'P' AS scored, o_orderdate + to_microseconds(o_orderkey) AS computed_at,
         last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH) AS date
  FROM orders JOIN zones z ON z.zone_id = 'Z' || o_custkey),
snapshots AS (
  SELECT zone_id, sector_name, lat, lon, rain_mm, tide_m, flow_m3s,
         CASE WHEN scored THEN CAST(printf('%.4f', {_R['score']}) AS DOUBLE) END AS risk_score,
         CASE WHEN scored THEN {_R['level']} END AS risk_level, computed_at, date
  FROM snapshot_inputs)"""


def tide_series(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Tide events (purchases and signups) and probes (all others) of the same stations."""
    events = table(spark, sf, "events")
    is_tide = F.col("event_type").isin("purchase", "signup")
    known = events.where(is_tide).select(
        F.col("user_id").alias("station"), "ts", (F.col("value") / 100.0).alias("height_m")
    )
    probes = events.where(~is_tide).select(
        "event_id", F.col("user_id").alias("station"), "ts"
    )
    return probes, known


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """Gridded cells: whole degrees, stored integers for SST and anomaly, half-hour rates."""
    return table(spark, sf, "lineitem").select(
        F.to_date("l_shipdate").alias("date"),
        (F.col("l_partkey") % 21 - 10).cast("double").alias("lat"),
        (F.col("l_suppkey") * 37 % 360 - 180).cast("double").alias("lon"),
        (F.col("l_quantity") * 100.0).alias("sst"),
        ((F.col("l_quantity") - 25.0) * 10.0).alias("anom"),
        (F.col("l_discount") + 0.0).alias("rate"),
        "l_returnflag",
        "l_tax",
        F.col("l_linenumber").alias("depth"),
    )


GRID_SQL = """
grid AS (
  SELECT CAST(l_shipdate AS DATE) AS date, (l_partkey % 21 - 10)::DOUBLE AS lat,
         (l_suppkey * 37 % 360 - 180)::DOUBLE AS lon, l_quantity * 100e0 AS sst, (l_quantity - 25e0) * 10e0 AS anom,
         l_discount + 0e0 AS rate, l_returnflag, l_tax, l_linenumber AS depth
  FROM lineitem)"""

REGIONS_SQL = """
regions(region, west, south, east, north) AS (VALUES
  ('nino12', -90e0, -10e0, -80e0, 0e0), ('nino3', -150e0, -5e0, -90e0, 5e0), ('nino34', -170e0, -5e0, -120e0, 5e0),
  ('nino4', 160e0, -5e0, 180e0, 5e0), ('nino4', -180e0, -5e0, -150e0, 5e0))"""


def places(spark: SparkSession, sf: str) -> DataFrame:
    lat, lon = lonlat("s_suppkey", 100, 50, 13)
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("place_id"), F.col("s_name").alias("name"), lat.alias("lat"), lon.alias("lon"),
        "s_nationkey", "s_acctbal",
    )


PLACES_SQL = """
places AS (
  SELECT s_suppkey AS place_id, s_name AS name, (s_suppkey % 100 - 50)::DOUBLE AS lat,
         (s_suppkey * 13 % 360 - 180)::DOUBLE AS lon, s_nationkey, s_acctbal
  FROM supplier)"""


def nodes_and_ways(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Nodes from parts (the largest sizes are unknown nodes), ways with a few node ids per order."""
    lat, lon = lonlat("p_partkey", 120, 60, 13)
    nodes = table(spark, sf, "part").where("p_size <= 45").select(
        F.col("p_partkey").alias("node_id"), lon.alias("lon"), lat.alias("lat")
    )
    n = (F.col("o_orderkey") % 6).cast("int")
    ids = F.transform(F.sequence(F.lit(0), n), lambda i: F.col("o_custkey") + i * 11)
    closed = F.concat(ids, F.array("o_custkey"))
    ways = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("way_id"), F.when(F.col("o_orderstatus") == "F", closed).otherwise(ids).alias("node_ids")
    )
    return nodes, ways


NODES_SQL = """
nodes AS (
  SELECT p_partkey AS node_id, (p_partkey * 13 % 360 - 180)::DOUBLE AS lon, (p_partkey % 120 - 60)::DOUBLE AS lat
  FROM part WHERE p_size <= 45),
way_lists AS (
  SELECT o_orderkey AS way_id, o_custkey, o_orderstatus, list_transform(range(o_orderkey % 6 + 1), lambda i: o_custkey + i * 11) AS ids FROM orders),
ways AS (
  SELECT way_id, CASE WHEN o_orderstatus = 'F' THEN list_append(ids, o_custkey) ELSE ids END AS node_ids FROM way_lists)"""


def with_sql(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body.strip()
