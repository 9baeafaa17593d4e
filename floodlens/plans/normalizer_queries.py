"""Per-source normalisers over payloads built from the test tables.

The Spark side builds each source's JSON and parses it again; the SQL side states the rows that must
come out, straight from the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from floodlens.operators.features import LAYERS
from floodlens.operators.drift import shape_drift
from floodlens.plans import views as v
from floodlens.plans.registry import query
from floodlens.sources import normalizers as n

_JSON = {"ignoreNullFields": "false"}


def _json(column):
    return F.to_json(column, _JSON).alias("json_str")


@query("normalize_weather_archive", """
    SELECT o_orderkey, strftime(o_orderdate + to_days(k::INTEGER), '%Y-%m-%d') AS date, o_totalprice + k AS mean_air_temp_c,
           CASE WHEN k = 0 OR o_orderstatus = 'F' THEN o_custkey::DOUBLE END AS precipitation_sum_mm, o_orderstatus <> 'F' AS is_ragged,
           (o_custkey + k)::DOUBLE AS max_wind_speed_ms, (o_custkey % 360 + k)::DOUBLE AS dominant_wind_direction_deg, k + 0.5e0 AS shortwave_radiation_mj_m2
    FROM orders, (SELECT unnest(range(2)) AS k)""")
def weather_archive(spark, sf):
    """Parallel arrays; the rain array is short unless the order is final."""
    day = [F.date_format(F.date_add(F.to_date("o_orderdate"), k), "yyyy-MM-dd") for k in range(2)]
    price, rain = F.col("o_totalprice"), F.col("o_custkey").cast("double")
    two = lambda c: F.array(c, c + 1)
    turn = (F.col("o_custkey") % 360).cast("double")
    docs = v.table(spark, sf, "orders").select("o_orderkey", _json(F.struct(F.struct(
        F.array(*day).alias("time"), F.array(price, price + 1).alias("temperature_2m_mean"),
        F.when(F.col("o_orderstatus") == "F", F.array(rain, rain)).otherwise(F.array(rain)).alias("precipitation_sum"),
        two(rain).alias("wind_speed_10m_max"), two(turn).alias("wind_direction_10m_dominant"), two(F.lit(0.5)).alias("shortwave_radiation_sum"),
    ).alias("daily"))))
    return n.weather_archive(docs).select(
        "o_orderkey", "date", "mean_air_temp_c", "precipitation_sum_mm", "is_ragged", "max_wind_speed_ms", "dominant_wind_direction_deg",
        "shortwave_radiation_mj_m2")


@query("normalize_local_daily", """
    SELECT o_orderkey, strftime(o_orderdate + to_days(k::INTEGER), '%Y%m%d') AS date, o_totalprice + k AS "temperature_2m_C",
           CASE WHEN k = 0 THEN o_custkey::DOUBLE ELSE -999e0 END AS precipitation_mm, -999e0 AS "surface_pressure_kPa"
    FROM orders, (SELECT unnest(range(2)) AS k) WHERE o_orderstatus <> 'P'""")
def local_daily(spark, sf):
    """Maps of maps; without the temperature map there are no rows."""
    day = [F.date_format(F.date_add(F.to_date("o_orderdate"), k), "yyyyMMdd") for k in range(2)]
    price = F.col("o_totalprice")
    temps = F.create_map(day[0], price + 0, day[1], price + 1)
    rain = F.create_map(day[0], F.col("o_custkey").cast("double"))
    maps = F.when(
        F.col("o_orderstatus") != "P", F.create_map(F.lit("T2M"), temps, F.lit("PRECTOTCORR"), rain)
    ).otherwise(F.create_map(F.lit("PRECTOTCORR"), rain))
    docs = v.table(spark, sf, "orders").select("o_orderkey", _json(F.struct(F.struct(maps.alias("parameter")).alias("properties"))))
    return n.local_daily(docs).select("o_orderkey", "date", "temperature_2m_C", "precipitation_mm", "surface_pressure_kPa")


@query("normalize_current_weather", """
    SELECT event_id, CAST(ts AS DATE)::VARCHAR AS date, value AS temperature_c, CASE WHEN event_type <> 'error' THEN user_id::DOUBLE END AS wind_speed_ms,
           CASE WHEN event_type = 'view' THEN 'N/A' WHEN event_type = 'click' THEN NULL ELSE event_type END AS weather_description
    FROM events""")
def current_weather(spark, sf):
    kind = F.col("event_type")
    weather = F.when(kind == "view", F.array().cast("array<struct<description:string>>")).otherwise(
        F.array(F.struct(F.when(kind != "click", kind).alias("description")))
    )
    docs = v.table(spark, sf, "events").select("event_id", F.to_date("ts").alias("day"), _json(F.struct(
        F.struct(F.col("value").alias("temp"), F.lit(80).alias("humidity")).alias("main"),
        F.when(kind != "error", F.struct(F.col("user_id").alias("speed"))).alias("wind"),
        weather.alias("weather"),
    )))
    return n.current_weather(docs, F.col("day")).select(
        "event_id", "date", "temperature_c", "wind_speed_ms", "weather_description"
    )


_OCEAN_SQL = """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, year(l_shipdate)::INTEGER AS year, month(l_shipdate)::INTEGER AS month, region,
           CASE region WHEN 'nino_1_2' THEN l_quantity WHEN 'nino_3' THEN l_extendedprice WHEN 'nino_4' THEN l_quantity + 1e0 ELSE l_quantity + 2e0 END AS sst,
           CASE region WHEN 'nino_1_2' THEN l_discount + 0e0 WHEN 'nino_3' THEN l_tax + 0e0 WHEN 'nino_4' THEN l_quantity / 2e0 ELSE -l_quantity END AS anomaly
    FROM lineitem, (SELECT unnest(['nino_1_2', 'nino_3', 'nino_4', 'nino_3_4']) AS region)"""
_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _ocean_cells():
    q = F.col("l_quantity")
    return [
        (q, F.col("l_discount") + 0.0), (F.col("l_extendedprice"), F.col("l_tax") + 0.0), (q + 1.0, q / 2.0), (q + 2.0, -q),
    ]


@query("ascii_table_parse", _OCEAN_SQL)
def ascii_table_parse(spark, sf):
    """A blank-delimited table per line item: repeated headings, runs of blanks, one data row."""
    cells = [c.cast("string") for pair in _ocean_cells() for c in pair]
    row = F.concat_ws("   ", F.year("l_shipdate").cast("string"), F.month("l_shipdate").cast("string"), *cells)
    text = F.concat(F.lit(" YR  MON NINO1+2  ANOM NINO3 ANOM   NINO4 ANOM NINO3.4 ANOM\n  "), row, F.lit("  \n"))
    return n.ocean_indices(v.table(spark, sf, "lineitem").select(*_LINE, text.alias("json_str")))


@query("normalize_ocean_payload", _OCEAN_SQL)
def ocean_payload(spark, sf):
    names = ("nino_1_2", "nino_3", "nino_4", "nino_3_4")
    regions = F.struct(*[
        F.struct(s.alias("sst"), a.alias("anomaly")).alias(name) for name, (s, a) in zip(names, _ocean_cells())
    ])
    month = F.struct(F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), regions.alias("regions"))
    envelope = F.struct(F.struct(F.lit("indices").alias("source")).alias("metadata"), F.array(month).alias("data"))
    return n.ocean_index_payload(v.table(spark, sf, "lineitem").select(*_LINE, _json(envelope)))


def _satellite_sql(days: str) -> str:
    """Expected rows, the region boxes written out. ``days`` selects the image days."""
    boxes = {
        "nino34": "lat BETWEEN -5 AND 5 AND lon BETWEEN -170 AND -120", "nino12": "lat BETWEEN -10 AND 0 AND lon BETWEEN -90 AND -80",
        "nino3": "lat BETWEEN -5 AND 5 AND lon BETWEEN -150 AND -90",
        "nino4": "lat BETWEEN -5 AND 5 AND (lon BETWEEN 160 AND 180 OR lon BETWEEN -180 AND -150)",
    }
    means = ", ".join(
        f"round(avg({c}) FILTER (WHERE {box}) / 100e0, 6) AS {r}_mean_{name}"
        for r, box in boxes.items() for c, name in (("sst", "sst"), ("anom", "anomaly")))
    return v.with_sql(v.GRID_SQL, body=f"""
    , days AS ({days}),
    w AS (SELECT date, {means} FROM grid JOIN days USING (date) GROUP BY date),
    cells AS (SELECT date, lat, lon, sum(rate) AS s FROM grid WHERE lat BETWEEN -10 AND 0 AND lon BETWEEN -90 AND -80 GROUP BY 1, 2, 3),
    rain AS (SELECT date, round(avg(s) / 2e0, 6) AS r FROM cells GROUP BY date)
    SELECT w.*, coalesce(r, 0e0) AS coast_precipitation_mm FROM w LEFT JOIN rain USING (date)""")


@query("normalize_satellite", _satellite_sql("SELECT DISTINCT date FROM grid"))
def satellite(spark, sf):
    """Every image day, whether it has cells in a region or not."""
    cells = v.grid(spark, sf)
    return n.satellite_daily(cells, cells, n_days=None)


@query("satellite_request", _satellite_sql(
    "SELECT DISTINCT date FROM grid WHERE date >= DATE '1995-03-01' AND date < DATE '1997-03-01' ORDER BY date LIMIT 15"))
def satellite_request(spark, sf):
    """A date range and its first fifteen days."""
    cells = v.grid(spark, sf)
    return n.satellite_daily(cells, cells, start="1995-03-01", end="1997-03-01")


@query("normalize_pressure", """
    SELECT CAST(ts AS DATE) AS date, round(avg(value) FILTER (WHERE event_type = 'view'), 6) AS tahiti_mslp_hpa,
           round(avg(value) FILTER (WHERE event_type = 'signup'), 6) AS darwin_mslp_hpa
    FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE event_type = 'view') > 0 AND count(*) FILTER (WHERE event_type = 'signup') > 0""")
def pressure(spark, sf):
    station = F.when(F.col("event_type") == "view", "tahiti").when(F.col("event_type") == "signup", "darwin")
    readings = v.table(spark, sf, "events").select(
        F.to_date("ts").alias("date"), station.alias("station"), F.col("value").alias("pressure_msl")
    )
    return n.pressure_index(readings).select(
        "date", *[F.round(c, 6).alias(c) for c in ("tahiti_mslp_hpa", "darwin_mslp_hpa")]
    )


@query("normalize_ocean_model", v.with_sql(v.GRID_SQL, body="""
    , days AS (SELECT DISTINCT date FROM grid WHERE l_returnflag = 'A' ORDER BY date DESC LIMIT 5),
    box AS (SELECT * FROM grid JOIN days USING (date) WHERE lat >= -5 AND lat <= 5 AND lon >= -170 AND lon <= -120),
    two AS (SELECT date, round(avg(sst), 6) AS z, round(avg(anom), 6) AS m FROM box WHERE l_returnflag = 'A' GROUP BY date),
    temp AS (SELECT date, round(avg(sst), 6) AS t FROM box
             WHERE l_returnflag = 'N' AND depth = (SELECT min(depth) FROM grid WHERE l_returnflag = 'N') GROUP BY date),
    salt AS (SELECT date, round(avg(anom), 6) AS s FROM box
             WHERE l_returnflag = 'R' AND depth = (SELECT min(depth) FROM grid WHERE l_returnflag = 'R') GROUP BY date),
    flow AS (SELECT date, round(avg(rate), 6) AS u, round(avg(l_tax), 6) AS w FROM box WHERE depth = (SELECT min(depth) FROM grid) GROUP BY date)
    SELECT date, z AS zos_meters, m AS mlotst_meters, t AS "thetao_degC", s AS so_psu, u AS uo_velocity_m_s, w AS vo_velocity_m_s
    FROM days LEFT JOIN two USING (date) LEFT JOIN temp USING (date) LEFT JOIN salt USING (date) LEFT JOIN flow USING (date)"""))
def ocean_model(spark, sf):
    cells = v.grid(spark, sf)
    place = ["date", "lat", "lon", "depth"]
    pick = lambda flag, **names: cells.where(F.col("l_returnflag") == flag).select(
        *place, *[F.col(c).alias(name) for name, c in names.items()]
    )
    currents = cells.select(*place, F.col("rate").alias("uo"), F.col("l_tax").alias("vo"))
    return n.ocean_model(pick("A", zos="sst", mlotst="anom"), pick("N", thetao="sst"), pick("R", so="anom"), currents)


def _station_payloads(spark, sf):
    """One payload per customer; every fifth half failed."""
    k = F.col("c_custkey")
    stations = F.struct(
        F.lit(1).alias("total_estaciones"),
        F.when(k % 5 == 0, "HTTP 500").alias("error"),
        F.array(F.struct(
            F.col("c_name").alias("punto_obs"), F.col("c_mktsegment").alias("canton"), F.lit("METEOROLÓGICA").alias("categoria"),
            F.lit("TRANSMITIENDO").alias("estado_transmision"), F.abs("c_acctbal").alias("altitud"),
        )).alias("estaciones"),
    )
    periods = F.array(*[
        F.struct(F.lit(p).alias("period_name"), F.concat(F.lit(p), F.lit(" "), F.col("c_mktsegment")).alias("condition_name"))
        for p in ("Mañana", "Tarde")
    ])
    forecast = F.struct(
        F.lit("2024-01-31").alias("fecha"), (k % 3).cast("int").alias("total_localidades"), F.when(k % 5 == 1, "timeout").alias("error"),
        F.array(F.struct(
            F.col("c_name").alias("locality_name"), F.lit(21.5).alias("min_temperature"), F.abs("c_acctbal").alias("max_temperature"),
            (k % 12).cast("double").alias("uv_radiation"), (k % 2 == 0).alias("rain"), periods.alias("forecast"),
        )).alias("pronostico"),
    )
    # A failed half carries no list.
    stations = F.when(k % 5 == 0, F.struct(F.lit(None).cast("int").alias("total_estaciones"), F.lit("HTTP 500").alias("error"),
        F.lit(None).cast("array<struct<punto_obs:string,canton:string,categoria:string,estado_transmision:string,altitud:double>>").alias("estaciones"),
    )).otherwise(stations)
    return v.table(spark, sf, "customer").select(
        k.alias("c_custkey"), _json(F.struct(stations.alias("estaciones"), forecast.alias("pronostico_diario")))
    )


@query("normalize_station_counts", """
    SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN 1 END::INTEGER AS total_estaciones, CASE WHEN c_custkey % 5 <> 0 THEN 1 END::INTEGER AS n_estaciones,
           CASE WHEN c_custkey % 5 <> 1 THEN c_custkey % 3 END::INTEGER AS total_localidades, CASE WHEN c_custkey % 5 <> 1 THEN 1 END::INTEGER AS n_localidades
    FROM customer""")
def station_counts(spark, sf):
    return n.station_counts(_station_payloads(spark, sf))


@query("normalize_stations", """
    SELECT c_custkey, c_name AS punto_obs, c_mktsegment AS canton, abs(c_acctbal) AS altitud,
           'METEOROLÓGICA' AS categoria, 'TRANSMITIENDO' AS estado_transmision FROM customer WHERE c_custkey % 5 <> 0""")
def stations(spark, sf):
    return n.stations(_station_payloads(spark, sf)).select(
        "c_custkey", "punto_obs", "canton", "altitud", "categoria", "estado_transmision")


@query("normalize_forecasts", """
    SELECT c_custkey, '2024-01-31' AS forecast_date, abs(c_acctbal) AS max_temperature, (c_custkey % 12)::DOUBLE AS uv_radiation,
           c_name AS locality_name, 21.5e0 AS min_temperature, c_custkey % 2 = 0 AS rain, 'Tarde ' || c_mktsegment AS afternoon FROM customer WHERE c_custkey % 5 <> 1""")
def forecasts(spark, sf):
    from floodlens.operators.payloads import first_match_or_head

    rows = n.forecasts(_station_payloads(spark, sf))
    afternoon = first_match_or_head("forecast", lambda f: f["period_name"] == "Tarde")["condition_name"]
    return rows.select("c_custkey", "forecast_date", "max_temperature", "uv_radiation", "locality_name", "min_temperature", "rain", afternoon.alias("afternoon"))


@query("normalize_failed_halves", """
    SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'estaciones' ELSE 'pronostico_diario' END AS half,
           CASE c_custkey % 5 WHEN 0 THEN 'HTTP 500' ELSE 'timeout' END AS error FROM customer WHERE c_custkey % 5 < 2""")
def failed_halves(spark, sf):
    return n.failed_halves(_station_payloads(spark, sf))


def _posts(spark, sf, lead):
    wrap = lambda c, name: F.struct(c.alias("rendered")).alias(name)
    return v.table(spark, sf, "documents").select("doc_id", _json(F.struct(
        wrap(F.concat(F.lit("<b>"), lead, F.lit("</b>")), "title"), wrap(F.lit("&nbsp;"), "excerpt"), wrap(F.col("text"), "content"),
        F.concat(F.lit("http://example.com/"), F.col("doc_id").cast("string")).alias("link"), F.lit("2024-01-31T10:00:00").alias("date_gmt"),
    )))


@query("normalize_reservoir_posts", """
    SELECT doc_id, 'Daule-Peripa' AS embalse, 'http://example.com/' || doc_id AS url_fuente, '2024-01-31T10:00:00' AS fecha_noticia,
           CASE doc_id % 4 WHEN 0 THEN 60 + doc_id % 40 + 0.5e0 WHEN 1 THEN 60 + doc_id % 40 + 0e0 END AS nivel_msnm,
           CASE doc_id % 4 WHEN 1 THEN 85.25e0 WHEN 2 THEN 60 + doc_id % 40 + 0.9e0 END AS nivel_maximo_msnm,
           CASE doc_id % 4 WHEN 0 THEN 'El embalse se encuentra en los ' || (60 + doc_id % 40) || ',5 m.s.n.m.'
                WHEN 1 THEN 'La cota del embalse se ubica en ' || (60 + doc_id % 40) || ' msnm. Su nivel máximo es 85,25 m.s.n.m.'
                ELSE 'Embalse: su nivel máximo es ' || (60 + doc_id % 40) || '.9 (m.s.n.m.)' END AS descripcion
    FROM documents WHERE lang <> 'de' AND doc_id % 4 < 3""")
def reservoir_posts(spark, sf):
    level = (F.col("doc_id") % 40 + 60).cast("string")
    leads = F.array(
        F.concat(F.lit("El embalse se encuentra en los "), level, F.lit(",5 m.s.n.m.")),
        F.concat(F.lit("La cota del embalse se ubica en "), level, F.lit(" msnm. Su nivel máximo es 85,25 m.s.n.m.")),
        F.concat(F.lit("Embalse: su nivel máximo es "), level, F.lit(".9 (m.s.n.m.)")), F.lit("El embalse no tiene novedades"))
    lead = F.when(F.col("lang") != "de", F.get(leads, (F.col("doc_id") % 4).cast("int"))).otherwise("Nada")
    return n.reservoir_posts(_posts(spark, sf, lead)).drop("fuente")


@query("normalize_alert_posts", """
    SELECT doc_id, canton, tipo_evento, severidad, descripcion, 'http://example.com/' || doc_id AS url_fuente, '2024-01-31T10:00:00' AS hora_evento
    FROM documents JOIN (VALUES
      (0, 'Daule', 'desbordamiento_rio', 'alta', 'Desborde en Daule, alerta naranja'), (1, 'Guayaquil', 'inundacion', 'critica', 'Alerta ROJA por inundación en Guayaquil y Daule'),
      (2, 'Durán', 'colapso_alcantarillado', 'media', 'Colapso de alcantarillado en Durán'), (3, 'El Empalme', 'deslizamiento', 'media', 'El Empalme: deslizamiento, alerta amarilla'),
      (4, 'Salitre', 'inundacion', 'media', 'Lluvias en SALITRE'), (5, 'Samborondón', 'deslizamiento', 'critica', 'Samborondón: deslizamiento y desborde, alerta roja y naranja'))
      AS t(k, canton, tipo_evento, severidad, descripcion) ON k = doc_id % 7
    WHERE lang <> 'de'""")
def alert_posts(spark, sf):
    leads = F.array(*map(F.lit, (
        "Desborde en Daule, alerta naranja", "Alerta ROJA por inundación en Guayaquil y Daule", "Colapso de alcantarillado en Durán",
        "El Empalme: deslizamiento, alerta amarilla", "Lluvias en SALITRE", "Samborondón: deslizamiento y desborde, alerta roja y naranja", "Reunión en Quito")))
    lead = F.when(F.col("lang") != "de", F.get(leads, (F.col("doc_id") % 7).cast("int"))).otherwise("Nada")
    return n.alert_posts(_posts(spark, sf, lead)).drop("fuente")


@query("normalize_tide_records", """
    SELECT event_id, 'Guayaquil' AS puerto, value AS altura_marea_m, CASE WHEN event_type = 'view' THEN 'subiendo' END AS tendencia, value > 2 AS pleamar
    FROM events""")
def tide_records(spark, sf):
    record = F.struct(
        F.lit("Guayaquil").alias("puerto"), F.col("value").alias("altura_marea_m"),
        F.when(F.col("event_type") == "view", "subiendo").alias("tendencia"), (F.col("value") > 2).alias("pleamar"),
    )
    return n.published(v.table(spark, sf, "events").select("event_id", _json(record)), "inocar_mareas").drop("fuente")


@query("normalize_buoys", v.with_sql(v.PLACES_SQL, body="""
    SELECT s_nationkey, place_id::VARCHAR AS id, name, 'Point' AS geometry_type, '[' || lon || ',' || lat || ']' AS coordinates FROM places"""))
def buoys(spark, sf):
    """Rows into collections and back."""
    rows = v.places(spark, sf).select(
        "s_nationkey", F.col("place_id").alias("id"), "name", "lat", "lon", F.lit(24.5).alias("water_temp_c"),
        F.lit(1.5).alias("wave_height_m"), F.lit(0.5).alias("current_velocity_kmh"), F.floor(F.col("place_id") / 200).alias("page"),
    )
    documents = n.buoy_collection(rows, ["s_nationkey"], F.col("page")).select("s_nationkey", F.col("collection").alias("json_str"))
    features = n.explode_features(documents, keep=["s_nationkey"])
    return features.select(
        "s_nationkey", F.col("properties")["id"].alias("id"), F.col("properties")["name"].alias("name"), "geometry_type", "coordinates"
    )


@query("normalize_rain_events", """
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Evento SGR' ELSE c_name END AS event, 'N/A' AS event_date, 'DAULE' AS canton,
           CASE WHEN c_custkey % 4 = 0 THEN '0' ELSE c_custkey::VARCHAR END AS people_affected,
           CASE WHEN c_custkey % 2 = 0 THEN 'note ' || c_nationkey ELSE '' END AS details,
           'Point' AS geometry_type, '[-79.9,-2.1]' AS coordinates
    FROM customer WHERE c_nationkey < 12""")
def rain_events(spark, sf):
    rows = n.rain_events(_rain_documents(spark, sf))
    return rows.select("c_custkey", "event", "event_date", "canton", "people_affected", "details", "geometry_type", "coordinates")


def _rain_documents(spark, sf):
    k = F.col("c_custkey")
    properties = F.struct(
        F.when(k % 3 == 0, "").otherwise(F.col("c_name")).alias("evento"),
        F.when(F.col("c_nationkey") < 12, "DAULE").otherwise("QUITO").alias("canton"),
        F.when(k % 4 != 0, k).alias("personasafectadasdirectamente"),
        F.when(k % 2 == 0, F.concat(F.lit("note "), F.col("c_nationkey"))).alias("descripciongeneraldeevento"),
    )
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array(F.lit(-79.9), F.lit(-2.1)).alias("coordinates")).alias("geometry"),
        properties.alias("properties"),
    )
    collection = F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features"))
    return v.table(spark, sf, "customer").select("c_custkey", _json(F.struct(collection.alias("data"))))


@query("rain_event_envelopes", """
    SELECT c_custkey, 'SGR Eventos Lluvia' AS source, CASE WHEN c_nationkey < 12 THEN 1 ELSE 0 END::INTEGER AS n_features,
           CASE WHEN c_nationkey < 12 THEN c_custkey % 3 = 0 END AS unnamed FROM customer""")
def rain_event_envelopes(spark, sf):
    """The published record of every document, with the features of the chosen cantons."""
    rows = n.rain_event_envelope(_rain_documents(spark, sf))
    first = F.get("data.features", F.lit(0))["properties"]
    return rows.select(
        "c_custkey", F.col("metadata.source").alias("source"), F.size("data.features").alias("n_features"),
        (F.try_element_at(first, F.lit("evento")) == "").alias("unnamed"),
    )


@query("unreadable_payloads", """
    SELECT CASE WHEN event_id % 7 = 0 THEN 'noaa' ELSE 'sngr_alertas' END AS source,
           CASE event_id % 5 WHEN 0 THEN 'broken' WHEN 1 THEN 'missing' WHEN 2 THEN 'no_object' END AS problem, count(*) AS n
    FROM events WHERE event_id % 5 < 3 GROUP BY 1, 2""")
def unreadable_payloads(spark, sf):
    """Of five payloads one is cut off, one empty, one a bare number; two are whole."""
    k = F.col("event_id")
    whole = F.to_json(F.struct(F.lit("alta").alias("severidad"), k.alias("valor")))
    text = F.when(k % 5 == 0, F.expr("substring('{\"severidad\":\"alta\",\"valor\":12}', 1, 10 + cast(event_id % 9 as int))")).when(
        k % 5 == 1, F.lit(" ")).when(k % 5 == 2, k.cast("string")).otherwise(whole)
    raw = v.table(spark, sf, "events").select(
        F.when(k % 7 == 0, "noaa").otherwise("sngr_alertas").alias("source"), text.alias("json_str"))
    return n.unreadable_payloads(raw).groupBy("source", "problem").agg(F.count(F.lit(1)).alias("n"))


@query("payload_shape_drift", """
    WITH e AS (SELECT event_id, event_type, CAST(ts AS DATE) AS date, day(ts) AS d FROM events WHERE event_type IN ('view', 'click'))
    SELECT 'celec_embalse' AS source, date, 'nivel_msnm' AS field, 'type' AS problem, 'double' AS expected, 'string' AS found
    FROM e WHERE event_type = 'click' AND d % 5 = 1 GROUP BY date
    UNION ALL SELECT 'celec_embalse', date, 'embalse', 'gone', 'string', NULL FROM e WHERE event_type = 'click' AND d % 5 = 2 GROUP BY date
    UNION ALL SELECT 'celec_embalse', date, 'nuevo', 'new', NULL, 'object' FROM e WHERE event_type = 'click' AND d % 5 = 3 GROUP BY date
    UNION ALL SELECT 'inocar_mareas', date, 'altura_marea_m', 'type', 'double', CASE WHEN count(DISTINCT event_id % 2) = 2 THEN 'variant' ELSE 'string' END
    FROM e WHERE event_type = 'view' AND d % 4 = 0 GROUP BY date HAVING count(*) FILTER (event_id % 2 = 0) > 0""")
def payload_shape_drift(spark, sf):
    """Payloads of two sources: on some days a number is text, a field is missing or one is new; broken texts count for nothing."""
    day = F.dayofmonth("ts")
    number = F.col("value").cast("decimal(12,2)").cast("string")
    level = F.when(day % 5 == 1, F.concat(F.lit('"'), number, F.lit('"'))).otherwise(number)
    reservoir = F.concat(
        F.lit('{"fuente":"f","descripcion":"d","url_fuente":"u","fecha_noticia":"n","nivel_maximo_msnm":null,"nivel_msnm":'), level,
        F.when(day % 5 != 2, ',"embalse":"Daule-Peripa"').otherwise(""), F.when(day % 5 == 3, ',"nuevo":{"x":1,"y":[2]}').otherwise(""), F.lit("}"))
    height = F.when((day % 4 == 0) & (F.col("event_id") % 2 == 0), F.concat(F.lit('"'), number, F.lit('"'))).otherwise(number)
    tide = F.concat(F.lit('{"fuente":"f","puerto":"p","tendencia":null,"pleamar":true,"altura_marea_m":'), height, F.lit("}"))
    events = v.table(spark, sf, "events").where(F.col("event_type").isin("view", "click")).withColumn("date", F.to_date("ts"))
    whole = events.select(
        F.when(F.col("event_type") == "view", "inocar_mareas").otherwise("celec_embalse").alias("source"), "date",
        F.when(F.col("event_type") == "view", tide).otherwise(reservoir).alias("json_str"))
    return shape_drift(whole.unionByName(whole.withColumn("json_str", F.expr("left(json_str, 9)"))))


@query("normalize_waterways", """
    SELECT o_orderkey, 7::BIGINT AS way_id, CASE WHEN o_orderstatus = 'F' THEN 'Polygon' ELSE 'LineString' END AS geometry_type,
           CASE WHEN o_orderstatus = 'F' THEN 4 ELSE 3 END AS n_points, 'river' AS waterway,
           CASE WHEN o_orderstatus = 'F' THEN CAST(to_json([[p1, p2, p3, p1]]) AS VARCHAR) ELSE CAST(to_json([p1, p2, p3]) AS VARCHAR) END AS coordinates
    FROM (SELECT *, [1e0, o_custkey % 50 + 1e0] AS p1, [2e0, o_custkey % 50 + 2e0] AS p2, [3e0, o_custkey % 50 + 3e0] AS p3 FROM orders)""")
def waterways(spark, sf):
    """An element list per order: three nodes, one way (closed when final) and one way of unknown nodes."""
    element = "struct<type:string,id:bigint,lon:double,lat:double,nodes:array<bigint>,tags:map<string,string>>"
    node = lambda i: F.struct(
        F.lit("node").alias("type"), F.lit(i).cast("long").alias("id"), F.lit(float(i)).alias("lon"),
        (F.col("o_custkey") % 50 + i).cast("double").alias("lat"),
        F.lit(None).cast("array<bigint>").alias("nodes"), F.lit(None).cast("map<string,string>").alias("tags"),
    ).cast(element)
    ids = lambda *xs: F.array(*[F.lit(x).cast("long") for x in xs])
    way = lambda i, nodes: F.struct(
        F.lit("way").alias("type"), F.lit(i).cast("long").alias("id"), F.lit(None).cast("double").alias("lon"),
        F.lit(None).cast("double").alias("lat"), nodes.alias("nodes"), F.create_map(F.lit("waterway"), F.lit("river")).alias("tags"),
    ).cast(element)
    closed = F.when(F.col("o_orderstatus") == "F", ids(1, 2, 3, 1)).otherwise(ids(1, 99, 2, 3))
    elements = F.array(node(1), node(2), node(3), way(7, closed), way(8, ids(98, 99, 1)))
    docs = v.table(spark, sf, "orders").select("o_orderkey", F.to_json(F.struct(elements.alias("elements"))).alias("json_str"))
    rows = n.waterways(docs, "o_orderkey")
    return rows.select("o_orderkey", "way_id", "geometry_type", "n_points", F.col("properties")["waterway"].alias("waterway"), "coordinates")


@query("normalize_layers", f"""
    SELECT p_partkey, layer, CASE layer WHEN 'sgr_sectores_celestes' THEN '#38bdf8' WHEN 'sgr_zonas_inundables' THEN 'rgba(64, 224, 208, 0.5)'
             WHEN 'sgr_vias_inundables' THEN '#ef4444' END AS color,
           CASE WHEN layer = 'sgr_sectores_celestes' THEN 'Distrito ' || p_size END AS name
    FROM (SELECT p_partkey, p_size, {list(LAYERS)!r}[p_size % {len(LAYERS)} + 1] AS layer FROM part)""")
def layer_pages(spark, sf):
    """Two pages per layer feature: one holding it, one empty."""
    names = F.array(*map(F.lit, LAYERS))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array(F.lit(1.0), F.lit(2.0)).alias("coordinates")).alias("geometry"),
        F.struct(F.col("p_size").alias("DISTRITO")).alias("properties"),
    )
    full, empty = F.array(feature), F.slice(F.array(feature), 1, 0)
    pages = v.table(spark, sf, "part").select(
        "p_partkey", F.get(names, F.col("p_size") % len(LAYERS)).alias("layer"), F.explode(F.array(full, empty)).alias("features")
    ).select("p_partkey", "layer", _json(F.struct(F.lit("FeatureCollection").alias("type"), "features")))
    prop = lambda k: F.try_element_at("properties", F.lit(k))
    return n.layer_pages(pages).select("p_partkey", "layer", prop("color").alias("color"), prop("name").alias("name"))
