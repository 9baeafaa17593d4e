"""Streaming jobs run to the end of the available data, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from floodlens.operators import series
from floodlens.operators.latest import latest_by_key
from floodlens.operators.scoring import current_conditions, score_zones
from floodlens.plans import views as v
from floodlens.plans.registry import query
from floodlens.plans.risk_queries import _R, RISK_CURRENT_SQL
from floodlens.plans.tide_queries import TIDE_SQL
from floodlens.session import shared_dir
from floodlens.sources.sinks import land_raw, read_snapshots, write_snapshots
from floodlens.sources.topics import source_of, to_raw, union_sources
from floodlens.sources.zones import write_zones
from floodlens.streaming.joins import join_within
from floodlens.streaming.keyed_state import bracket_stream, latest_values, newest_versions
from floodlens.streaming.landing import MonitorConfig, run_monitor
from floodlens.streaming.windows import drop_retries, latest_by_source, rain_24h, upsert_by_epoch

_RAW_ROWS = "SELECT json_str, kafka_timestamp, source, date FROM raw"


def _land(spark, stream, purpose: str):
    base = shared_dir(spark, purpose)
    land_raw(stream, f"{base}/data", f"{base}/_checkpoint", once=True).awaitTermination()
    return spark.read.parquet(f"{base}/data")


@query("topic_stream_landing", v.with_sql(v.RAW_SQL, body=_RAW_ROWS))
def topic_stream_landing(spark, sf):
    rows = _land(spark, to_raw(v.topic_records(v.event_stream(spark, sf))), "landing")
    return rows.select("json_str", v.ntz("kafka_timestamp").alias("kafka_timestamp"), "source", "date")


@query("topic_to_source_map", """
    SELECT topic, CASE topic WHEN 'mareas-inocar' THEN 'inocar_mareas' WHEN 'nivel-embalse-celec' THEN 'celec_embalse'
                  WHEN 'inamhi-data' THEN 'inamhi' WHEN 'noaa-data' THEN 'noaa' WHEN 'alertas-sngr' THEN 'sngr_alertas' END AS source,
           count(*) AS n_records
    FROM (SELECT CASE event_type WHEN 'view' THEN 'mareas-inocar' WHEN 'click' THEN 'nivel-embalse-celec'
                 WHEN 'purchase' THEN 'inamhi-data' WHEN 'signup' THEN 'noaa-data' WHEN 'error' THEN 'alertas-sngr' END AS topic
          FROM events) GROUP BY 1, 2""")
def topic_to_source_map(spark, sf):
    records = v.topic_records(v.table(spark, sf, "events"))
    return records.groupBy("topic").agg(F.count(F.lit(1)).alias("n_records")).withColumn("source", source_of("topic"))


@query("union_sources", """
    SELECT 'readings' AS source, event_id AS record_id, ts AS recorded_at, value AS amount FROM events
    UNION ALL SELECT 'orders', o_orderkey, o_orderdate, o_totalprice FROM orders
    UNION ALL SELECT 'lines', l_orderkey, l_shipdate, l_extendedprice FROM lineitem""")
def all_sources(spark, sf):
    t = lambda name, *cols: v.table(spark, sf, name).select(
        *[F.col(c).alias(n) for c, n in zip(cols, ("record_id", "recorded_at", "amount"))]
    )
    return union_sources({
        "readings": t("events", "event_id", "ts", "value"),
        "orders": t("orders", "o_orderkey", "o_orderdate", "o_totalprice"),
        "lines": t("lineitem", "l_orderkey", "l_shipdate", "l_extendedprice"),
    })


@query("scored_snapshot_sink", v.with_sql(
    v.ZONES_SQL, v.RAW_SQL, v.LATEST_SQL, v.CONDITIONS_SQL,
    body=f"""SELECT zone_id, rain_mm, tide_m, flow_m3s, CAST(printf('%.4f', {_R['score']}) AS DOUBLE) AS risk_score,
       {_R['level']} AS risk_level, TIMESTAMP '2024-01-31 00:00:00' AS computed_at, DATE '2024-01-31' AS date
       FROM zones CROSS JOIN conditions"""))
def scored_snapshot_sink(spark, sf):
    """One epoch written twice: the retry replaces the first attempt."""
    path = shared_dir(spark, "snapshots")
    scored = score_zones(v.zones(spark, sf), current_conditions(v.raw(spark, sf)))
    for _ in range(2):
        write_snapshots(scored, path, epoch_id=7, as_of="2024-01-31 00:00:00")
    return read_snapshots(spark, path).select(
        "zone_id", "rain_mm", "tide_m", "flow_m3s", "risk_score", "risk_level",
        v.ntz("computed_at").alias("computed_at"), "date",
    )


@query("stream_risk", RISK_CURRENT_SQL.replace(", as_of\n", "\n"))
def stream_risk(spark, sf):
    """Topic files consumed in several ticks; the last tick's scores are those of all data."""
    base = shared_dir(spark, "monitor")
    records = v.topic_records(v.table(spark, sf, "events"))
    records.repartitionByRange(3, "timestamp").write.parquet(f"{base}/topics")
    write_zones(v.zones(spark, sf), f"{base}/zones")
    run_monitor(spark, MonitorConfig(
        base=base, zones_path=f"{base}/zones", topic_files=f"{base}/topics", max_files_per_trigger=1,
        as_of="2024-01-31 00:00:00",
    ))
    rows = spark.read.parquet(f"{base}/snapshots")
    last = rows.agg(F.max("epoch_id")).scalar()  # one run
    return rows.where(F.col("epoch_id") == last).select(
        "zone_id", "sector_name", "lat", "lon", "rain_mm", "tide_m", "flow_m3s", "risk_score", "risk_level"
    )


@query("stream_latest_by_source", v.with_sql(
    v.RAW_SQL, v.LATEST_SQL, body="SELECT source, kafka_timestamp, json_str FROM latest"))
def stream_latest_by_source(spark, sf):
    base = shared_dir(spark, "latest")
    stream = latest_by_source(to_raw(v.topic_records(v.event_stream(spark, sf))))
    upsert_by_epoch(stream, f"{base}/data", f"{base}/_checkpoint").awaitTermination()
    state = spark.read.parquet(f"{base}/data")
    rows = latest_by_key(state, ["source"], "epoch_id", [], ["kafka_timestamp", "json_str"])
    return rows.select("source", v.ntz("kafka_timestamp").alias("kafka_timestamp"), "json_str")


@query("rain_24h_window", """
    WITH hours AS (SELECT user_id AS station, date_trunc('hour', ts) AS hour, sum(value) AS s, count(*) AS n
                   FROM events GROUP BY 1, 2)
    SELECT station, hour - to_hours(k::BIGINT) AS window_start, hour - to_hours(k::BIGINT) + INTERVAL 24 HOUR AS window_end,
           round(sum(s), 4) AS rain_24h_mm, sum(n)::BIGINT AS n_readings
    FROM hours, (SELECT unnest(range(24)) AS k) GROUP BY 1, 2, 3""")
def rain_24h_window(spark, sf):
    readings = v.table(spark, sf, "events").select(
        F.col("user_id").alias("station"), F.col("ts").cast("timestamp").alias("ts"), "value"
    )
    rows = rain_24h(readings, "station", "ts", "value")
    return rows.select(
        "station", v.ntz("window_start").alias("window_start"), v.ntz("window_end").alias("window_end"),
        F.round("rain_24h_mm", 4).alias("rain_24h_mm"), "n_readings",
    )


@query("stream_dedup", "SELECT event_id, event_type AS source, CAST(ts AS DATE) AS date, value FROM events")
def stream_dedup(spark, sf):
    """Every record sent twice, landed once."""
    sent = v.event_stream(spark, sf).select(
        "event_id", F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("ts"), "value",
        F.to_date("ts").alias("date"), F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt"),
    )
    once = drop_retries(sent, ["source", "event_id"], "ts").drop("attempt")
    return _land(spark, once, "dedup").select("event_id", "source", "date", "value")


_VALUES = ("rain_mm", "tide_m", "flow_m3s", "risk_score", "risk_level")


@query("stream_latest_values", v.with_sql(v.ZONES_SQL, v.SNAPSHOTS_SQL, body="SELECT zone_id, " + ", ".join(
    f"arg_max({c}, computed_at) FILTER (WHERE {c} IS NOT NULL) AS {c}, max(computed_at) FILTER (WHERE {c} IS NOT NULL) AS {c}__at" for c in _VALUES)
    + " FROM snapshots GROUP BY zone_id"))
def stream_latest_values(spark, sf):
    """Snapshots as a stream in no order of time, consumed in two runs of one checkpoint: latest value of every column and zone."""
    base = shared_dir(spark, "latest-values")
    rows = v.snapshots(spark, sf).select("zone_id", "computed_at", *_VALUES)
    parts = rows.withColumn("part", F.pmod(F.xxhash64("zone_id", "computed_at"), F.lit(3)))
    parts.write.partitionBy("part").parquet(f"{base}/in")
    schema = spark.read.parquet(f"{base}/in").drop("part").schema

    def consume(folders: str) -> None:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{base}/in/{folders}")
        upsert_by_epoch(latest_values(stream, "zone_id", "computed_at", _VALUES), f"{base}/out", f"{base}/_checkpoint").awaitTermination()

    consume("part=[01]")
    consume("part=[012]")
    stamps = [f"{c}__at" for c in _VALUES]
    found = newest_versions(spark.read.parquet(f"{base}/out"), "zone_id", [*_VALUES, *stamps])
    return found.withColumns({c: v.ntz(c) for c in stamps})


# Instants that the watermark of the whole events table, two hours behind the newest, has passed for sure.
_CLOSED_SQL = "(SELECT date_trunc('hour', max(ts)) - INTERVAL {} HOUR FROM events)"


def _closed(spark, sf, hours: int):
    newest = v.table(spark, sf, "events").agg((F.date_trunc("hour", F.max("ts")) - F.expr(f"interval {hours} hours")).alias("closed"))
    return newest.scalar()


@query("stream_tide_interpolate", f"""WITH {TIDE_SQL}
    SELECT event_id, station, ts, t0, t1, CAST(printf('%.3f', h) AS DOUBLE) AS height_m,
           CASE WHEN h IS NOT NULL THEN CASE WHEN h1 > h0 THEN 'subiendo' ELSE 'bajando' END END AS trend,
           CASE WHEN h IS NOT NULL THEN h >= greatest(h0, h1) - 0.3e0 END AS high_tide
    FROM interp WHERE t1 <= {_CLOSED_SQL.format(3)}""")
def stream_tide_interpolate(spark, sf):
    """Tide events and probes in one stream: a probe is answered when the event after it is final."""
    base = shared_dir(spark, "bracket")
    is_tide = F.col("event_type").isin("purchase", "signup")
    readings = v.event_stream(spark, sf).select(
        "event_id", F.col("user_id").alias("station"), "ts", F.when(is_tide, F.col("value") / 100.0).alias("height_m"))
    found = bracket_stream(readings, "station", "ts", "height_m", ["event_id"])
    writer = found.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/_checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    rows = series.interpolate(spark.read.parquet(f"{base}/out"))
    at = lambda c: v.ntz(F.timestamp_micros(c)).alias(c)
    rows = rows.select("event_id", "station", v.ntz("ts").alias("ts"), at("t0"), at("t1"), "height_m", "trend", "high_tide")
    return rows.where(F.col("t1") <= _closed(spark, sf, 3))


@query("stream_rain_tide_join", f"""
    WITH rain AS (SELECT user_id % 25 AS station, event_id AS rain_id, ts, value AS rain_mm FROM events WHERE event_type = 'purchase'),
    tide AS (SELECT user_id % 25 AS station, ts AS tide_ts, value / 100e0 AS tide_m FROM events WHERE event_type = 'view')
    SELECT rain.station, rain_id, ts, rain_mm, tide_ts, tide_m
    FROM rain LEFT JOIN tide ON tide.station = rain.station AND tide_ts BETWEEN ts - INTERVAL 1 HOUR AND ts + INTERVAL 1 HOUR
    WHERE ts < {_CLOSED_SQL.format(5)}""")
def stream_rain_tide_join(spark, sf):
    """Two streams: rain readings with the tide readings of their station within an hour, and those without one."""
    base = shared_dir(spark, "rain-tide")

    def side(kind: str, *columns):
        return v.event_stream(spark, sf).where(F.col("event_type") == kind).select((F.col("user_id") % 25).alias("station"), "ts", *columns)

    rain = side("purchase", F.col("event_id").alias("rain_id"), F.col("value").alias("rain_mm"))
    tide = side("view", (F.col("value") / 100.0).alias("tide_m"))
    joined = join_within(rain, tide, "station", columns=["tide_m"])
    writer = joined.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/_checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{base}/out").select("station", "rain_id", v.ntz("ts").alias("ts"), "rain_mm", v.ntz("right_ts").alias("tide_ts"), "tide_m")
    return rows.where(F.col("ts") < _closed(spark, sf, 5))
