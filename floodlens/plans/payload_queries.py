"""Payload shapes and daily merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from floodlens.functions import scalars as sc
from floodlens.functions.geometry import OCEAN_REGIONS
from floodlens.operators import features, grids, payloads
from floodlens.operators.partials import RegionPartials
from floodlens.plans import views as v
from floodlens.plans.registry import query
from floodlens.session import shared_dir
from floodlens.sources.envelopes import from_envelope, to_envelope, write_topic
from floodlens.sources.sinks import land_raw
from floodlens.sources.topics import topic_stream


@query("zip_arrays", """
    SELECT o_orderkey, day, CASE k WHEN 0 THEN o_totalprice WHEN 1 THEN o_totalprice * 2e0 ELSE o_totalprice * 4e0 END AS temp,
           CASE WHEN k < n_rain THEN (o_custkey + k)::DOUBLE END AS rain, n_rain <> 3 AS is_ragged
    FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 0 END AS n_rain FROM orders),
         (SELECT unnest(range(3)) AS k),
         LATERAL (SELECT strftime(o_orderdate + to_days(k::INTEGER), '%Y-%m-%d') AS day)""")
def zip_arrays(spark, sf):
    """Per-order payload of parallel arrays; one of them short or missing."""
    d, price, cust = F.to_date("o_orderdate"), F.col("o_totalprice"), F.col("o_custkey")
    rain = F.array(*[(cust + k).cast("double") for k in range(3)])
    docs = v.table(spark, sf, "orders").select(
        "o_orderkey",
        F.array(*[F.date_format(F.date_add(d, k), "yyyy-MM-dd") for k in range(3)]).alias("day"),
        F.array(price, price * 2.0, price * 4.0).alias("temp"),
        F.when(F.col("o_orderstatus") == "F", rain)
        .when(F.col("o_orderstatus") == "O", F.slice(rain, 1, 2)).alias("rain"),
    )
    return payloads.zip_rows(docs, "day", {"temp": "temp", "rain": "rain"}, ["o_orderkey"]).drop("pos")


@query("param_align", """
    SELECT o_orderkey, strftime(o_orderdate + to_days(k::INTEGER), '%Y-%m-%d') AS date, o_totalprice + k AS t2m,
           CASE WHEN o_orderstatus = 'F' OR (o_orderstatus = 'O' AND k = 0) THEN (o_custkey + k)::DOUBLE ELSE -999e0 END AS rain,
           CASE WHEN k = 1 THEN (o_custkey * 2)::DOUBLE END AS wind
    FROM orders, (SELECT unnest(range(2)) AS k)""")
def param_align(spark, sf):
    """Per-order maps of date to value: partly missing, and present without a value."""
    days = [F.date_format(F.date_add(F.to_date("o_orderdate"), k), "yyyy-MM-dd") for k in range(2)]
    cust = F.col("o_custkey")
    values = [(cust + k).cast("double") for k in range(2)]
    docs = v.table(spark, sf, "orders").select(
        "o_orderkey",
        F.create_map(days[0], F.col("o_totalprice") + 0, days[1], F.col("o_totalprice") + 1).alias("t2m"),
        F.when(F.col("o_orderstatus") == "F", F.create_map(days[0], values[0], days[1], values[1]))
        .when(F.col("o_orderstatus") == "O", F.create_map(days[0], values[0])).alias("rain_map"),
        F.create_map(days[0], F.lit(None).cast("double"), days[1], (cust * 2).cast("double")).alias("wind_map"),
        F.lit(None).cast("map<string,double>").alias("sun_map"),
    )
    rows = payloads.align_params(
        docs, "t2m", {"rain": "rain_map", "wind": "wind_map", "sun": "sun_map"}, ["o_orderkey"]
    )
    return payloads.sentinel_to_null(rows, ["sun"]).where(F.col("sun").isNull()).drop("sun")


@query("unpivot_regions", """
    SELECT l_orderkey, l_linenumber, region, CASE region WHEN 'nino_1_2' THEN l_quantity WHEN 'nino_3' THEN l_extendedprice
             WHEN 'nino_4' THEN l_discount + 0e0 ELSE l_tax + 0e0 END AS sst,
           CASE region WHEN 'nino_1_2' THEN l_quantity - 25e0 WHEN 'nino_3' THEN l_extendedprice / 2e0
             WHEN 'nino_4' THEN l_discount * 2e0 + 0e0 ELSE NULL END AS anomaly
    FROM lineitem, (SELECT unnest(['nino_1_2', 'nino_3', 'nino_4', 'nino_3_4']) AS region)""")
def unpivot_regions(spark, sf):
    q, p, d, t = (F.col(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    return payloads.unpivot_regions(v.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], {
        "nino_1_2": (q, q - 25.0),
        "nino_3": (p, p / 2.0),
        "nino_4": (d + 0.0, d * 2.0 + 0.0),
        "nino_3_4": (t + 0.0, F.lit(None).cast("double")),
    })


_WORDS = "string_split(text, ' ')"


@query("array_ends", f"SELECT doc_id, {_WORDS}[1] AS head, {_WORDS}[-1] AS last FROM documents")
def array_ends(spark, sf):
    words = v.table(spark, sf, "documents").select("doc_id", F.split("text", " ").alias("words"))
    return words.select("doc_id", payloads.head_of("words").alias("head"), payloads.last_of("words").alias("last"))


@query("payload_counts", f"""
    SELECT source, count(*) AS n_payloads, sum(len({_WORDS}))::BIGINT AS n_records FROM documents GROUP BY source""")
def payload_counts(spark, sf):
    return v.table(spark, sf, "documents").groupBy("source").agg(
        F.count(F.lit(1)).alias("n_payloads"), F.sum(F.size(F.split("text", " "))).cast("long").alias("n_records")
    )


@query("first_match_or_head", f"""
    SELECT doc_id, coalesce(list_filter({_WORDS}, lambda w: starts_with(w, 'th'))[1], {_WORDS}[1]) AS chosen FROM documents""")
def first_match_or_head(spark, sf):
    chosen = payloads.first_match_or_head(F.split("text", " "), lambda w: F.startswith(w, F.lit("th")))
    return v.table(spark, sf, "documents").select("doc_id", chosen.alias("chosen"))


@query("noon_samples", """
    SELECT event_id, value, strftime(ts, '%m-%d') AS label FROM events WHERE strftime(date_trunc('hour', ts), '%H:%M') = '12:00'""")
def noon_samples(spark, sf):
    hourly = v.table(spark, sf, "events").withColumn("hour", F.date_trunc("hour", F.col("ts").cast("timestamp")))
    return payloads.noon_samples(hourly, "hour").select("event_id", "value", "label")


@query("daily_merge", v.with_sql(v.GRID_SQL, body="""
    , base AS (SELECT * FROM grid WHERE l_returnflag = 'A'),
    days AS (SELECT DISTINCT date FROM base ORDER BY date DESC LIMIT 5),
    a AS (SELECT date, round(avg(sst), 6) AS zos, round(avg(l_tax), 6) AS mlotst FROM base GROUP BY date),
    b AS (SELECT date, round(avg(anom), 6) AS thetao FROM grid WHERE l_returnflag = 'N' AND depth = (SELECT min(depth) FROM grid WHERE l_returnflag = 'N') GROUP BY date),
    c AS (SELECT date, round(avg(rate), 6) AS so FROM grid WHERE l_returnflag = 'R' GROUP BY date)
    SELECT a.date, zos, mlotst, thetao, so FROM a JOIN days USING (date) LEFT JOIN b USING (date) LEFT JOIN c USING (date)"""))
def daily_merge(spark, sf):
    cells = v.grid(spark, sf)
    part = lambda flag: cells.where(F.col("l_returnflag") == flag)
    return payloads.merge_daily(
        part("A"),
        [(grids.surface_only(part("N")), {"anom": "thetao"}), (part("R"), {"rate": "so"})],
        {"sst": "zos", "l_tax": "mlotst"},
    )


@query("region_daily_mean", v.with_sql(v.GRID_SQL, v.REGIONS_SQL, body="""
    SELECT region, date, round(avg(sst) / 100e0, 6) AS mean_sst, round(avg(anom) / 100e0, 6) AS mean_anom, count(*) AS n_cells
    FROM (SELECT DISTINCT region, g.* FROM (SELECT row_number() OVER () AS rid, * FROM grid) g JOIN regions r
          ON lat BETWEEN south AND north AND lon BETWEEN west AND east)
    WHERE date >= DATE '1996-01-01' AND date < DATE '2001-01-01' GROUP BY region, date"""))
def region_daily_mean(spark, sf):
    return grids.region_daily_mean(
        v.grid(spark, sf), {"sst": 100.0, "anom": 100.0}, start="1996-01-01", end="2001-01-01"
    )


@query("region_first_days", v.with_sql(v.GRID_SQL, v.REGIONS_SQL, body="""
    , days AS (SELECT DISTINCT date FROM grid WHERE date >= DATE '1997-03-01' ORDER BY date LIMIT 15)
    SELECT region, date, round(avg(sst) / 100e0, 6) AS mean_sst, count(*) AS n_cells
    FROM (SELECT DISTINCT region, g.* FROM (SELECT row_number() OVER () AS rid, * FROM grid) g JOIN regions r
          ON lat BETWEEN south AND north AND lon BETWEEN west AND east)
    WHERE date IN (SELECT date FROM days) GROUP BY region, date"""))
def region_first_days(spark, sf):
    """The first fifteen days from a start date on, as the satellite source asks for them."""
    return grids.region_daily_mean(v.grid(spark, sf), {"sst": 100.0}, start="1997-03-01", n_days=15)


@query("daily_rain", v.with_sql(v.GRID_SQL, body="""
    , cells AS (SELECT date, lat, lon, sum(rate) AS s FROM grid
                WHERE lat BETWEEN -10 AND 0 AND lon BETWEEN -90 AND -80 GROUP BY 1, 2, 3),
    rain AS (SELECT date, round(avg(s) / 2e0, 6) AS rain_mm FROM cells GROUP BY date)
    SELECT d.date, coalesce(rain_mm, 0e0) AS rain_mm FROM (SELECT DISTINCT date FROM grid) d LEFT JOIN rain USING (date)"""))
def daily_rain(spark, sf):
    cells = v.grid(spark, sf)
    rain = grids.daily_region_rain(cells, OCEAN_REGIONS[0])
    return grids.with_daily_rain(cells.select("date").distinct(), rain)


@query("pressure_difference", """
    WITH p AS (SELECT CAST(ts AS DATE) AS date, avg(CASE WHEN event_type = 'view' THEN value END) AS a,
                      avg(CASE WHEN event_type = 'click' THEN value END) AS b FROM events GROUP BY 1)
    SELECT date, round(a, 6) AS first_value, round(b, 6) AS second_value, round(a - b, 6) AS difference,
           CASE WHEN a - b < -1 THEN 'Fase El Niño (Acoplamiento Atmosférico)' WHEN a - b > 1 THEN 'Fase La Niña' ELSE 'Fase Neutra' END AS phase,
           upper(CASE WHEN a - b < -1 THEN 'Fase El Niño (Acoplamiento Atmosférico)' WHEN a - b > 1 THEN 'Fase La Niña' ELSE 'Fase Neutra' END) AS shown
    FROM p WHERE a IS NOT NULL AND b IS NOT NULL""")
def pressure_difference(spark, sf):
    events = v.table(spark, sf, "events").withColumn("date", F.to_date("ts"))
    rows = payloads.pair_difference(events, "event_type", "view", "click", "value", ["date"])
    phase = sc.pressure_phase("difference")
    return rows.select(
        "date", *[F.round(c, 6).alias(c) for c in ("first_value", "second_value", "difference")],
        phase.alias("phase"), F.upper(phase).alias("shown"),
    )


@query("property_lookup", """
    SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN s_name WHEN 1 THEN s_name || '-b' WHEN 2 THEN s_name || '-c' ELSE 'Desconocida' END AS location,
           CASE WHEN s_suppkey % 5 < 4 THEN s_suppkey::VARCHAR ELSE 'N/A' END AS zone_number
    FROM supplier""")
def property_lookup(spark, sf):
    k, name = F.col("s_suppkey"), F.col("s_name")
    zone, empty = (F.lit("N_ZONA"), k.cast("string")), F.lit("")
    props = (
        F.when(k % 5 == 0, F.create_map(*zone, F.lit("UBICACIÓN"), name, F.lit("UBICACION"), F.lit("other")))
        .when(k % 5 == 1, F.create_map(*zone, F.lit("UBICACIÓN"), empty, F.lit("UBICACION"), F.concat(name, F.lit("-b"))))
        .when(k % 5 == 2, F.create_map(*zone, F.lit("X_UBICACI_1"), F.concat(name, F.lit("-c"))))
        .when(k % 5 == 3, F.create_map(*zone, F.lit("UBICACIÓN"), empty))
        .otherwise(F.create_map(F.lit("N_ZONA"), empty))
    )
    cards = features.safe_zone_card(v.table(spark, sf, "supplier").withColumn("properties", props))
    return cards.select("s_suppkey", "location", "zone_number")


@query("envelope_roundtrip", """
    SELECT user_id::VARCHAR AS key, event_id, value, CAST(ts AS DATE)::VARCHAR AS day,
           CASE WHEN event_type = 'error' THEN 'sent-' || event_id ELSE '2024-02-01T06:30:00.000000+00:00' END AS ingested_at
    FROM events""")
def envelope_roundtrip(spark, sf):
    """Envelopes sent to a topic, consumed from it as a stream, landed and read."""
    records = v.table(spark, sf, "events").select(
        "user_id", "event_id", "value", F.to_date("ts").alias("day"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("sent-"), F.col("event_id").cast("string"))).alias("ingested_at"),
    )
    sent = to_envelope(records, F.lit("2024-02-01 06:30:00").cast("timestamp"), F.col("user_id"))
    base, topic = shared_dir(spark, "envelopes"), "mareas-inocar"
    write_topic(sent, topic, path=f"{base}/topic")
    stream = topic_stream(spark, [topic], path=f"{base}/topic", keep=["key"])
    land_raw(stream, f"{base}/raw", f"{base}/_checkpoint", once=True).awaitTermination()
    landed = spark.read.parquet(f"{base}/raw").select(F.col("key").cast("string").alias("key"), F.col("json_str").alias("value"))
    return from_envelope(landed, "event_id BIGINT, value DOUBLE, day STRING, ingested_at STRING")


@query("region_partials_two_loads", v.with_sql(v.GRID_SQL, v.REGIONS_SQL, body="""
    SELECT region, date, round(sum(sst) / count(sst) / 100e0, 6) AS mean_sst, round(sum(anom) / count(anom) / 100e0, 6) AS mean_anom, count(*) AS n_cells
    FROM (SELECT DISTINCT region, g.* FROM (SELECT row_number() OVER () AS rid, * FROM grid) g JOIN regions r
          ON lat BETWEEN south AND north AND lon BETWEEN west AND east)
    GROUP BY region, date"""))
def region_partials_two_loads(spark, sf):
    """Cells landed by month in two loads, the second with late cells of the last months; sums are renewed where files changed."""
    base = shared_dir(spark, "partials")
    cells = v.grid(spark, sf).select("date", "lat", "lon", "sst", "anom", "depth", F.trunc("date", "month").alias("month"))
    late = (F.col("date") >= F.lit("1998-03-01").cast("date")) & (F.col("depth") > 3)
    partials = RegionPartials(spark, f"{base}/cells", f"{base}/sums", {"sst": 100.0, "anom": 100.0}, part="month")
    for load in (~late, late):
        cells.where(load).hint("rebalance", "month").write.mode("append").partitionBy("month").parquet(f"{base}/cells")
        partials.refresh()
    return partials.means("day")
