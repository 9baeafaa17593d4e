"""Readers, envelopes, text tables, normalisers and sinks."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from floodlens.sources import envelopes, layers, normalizers, sinks, text_tables, topics, zones


def test_zone_file(spark, tmp_path):
    (tmp_path / "z.csv").write_text(
        "zona_id,nombre_sector,lat_centroide,lon_centroide,cota_media_msnm,pendiente_clase,historicamente_inundable,cercania_estero_m\n"
        "Q1,Norte,-1.5,-79.5,6,plana,TRUE,150\nQ2,Sur,-1.6,-79.6,7.5,suave,no,80\n", encoding="utf-8")
    rows = zones.read_zones(spark, str(tmp_path / "z.csv")).orderBy("zone_id").collect()
    assert [(r.zone_id, r.elevation_m, r.flood_history) for r in rows] == [("Q1", 6.0, True), ("Q2", 7.5, False)]
    (tmp_path / "bad.csv").write_text("zona_id,nombre_sector,lat_centroide,lon_centroide,cota_media_msnm,pendiente_clase,historicamente_inundable,cercania_estero_m\nQ1,N,abc,1,1,plana,true,1\n")
    with pytest.raises(Exception):
        zones.read_zones(spark, str(tmp_path / "bad.csv")).collect()


def test_kafka_options_and_map(spark):
    options = topics.kafka_options("broker:9092", ["a", "b"])
    assert options["subscribe"] == "a,b" and options["startingOffsets"] == "earliest" and options["failOnDataLoss"] == "false"
    df = spark.createDataFrame([("mareas-inocar", b"{}"), ("unknown", b"{}")], "topic STRING, value BINARY").withColumn("timestamp", F.lit("2024-01-02 03:04:05"))
    rows = topics.to_raw(df).collect()
    assert [(r.source, r.json_str, str(r.date)) for r in rows] == [("inocar_mareas", "{}", "2024-01-02"), ("unmapped", "{}", "2024-01-02")]
    assert int(options["maxOffsetsPerTrigger"]) > 0
    with pytest.raises(ValueError, match="nowhere"):
        topics.topic_stream(spark, ["mareas-inocar", "nowhere"], path="/tmp")
    with pytest.raises(ValueError):
        topics.topic_stream(spark)


def test_envelope_keeps_nulls_and_own_stamp(spark):
    df = spark.createDataFrame([(1, None, "mine"), (2, "x", None)], "a INT, b STRING, ingested_at STRING")
    sent = envelopes.to_envelope(df, F.lit("2024-01-01 00:00:00").cast("timestamp"), F.col("a"))
    docs = [json.loads(bytes(r.value)) for r in sent.collect()]
    assert docs[0] == {"a": 1, "b": None, "ingested_at": "mine"}
    assert docs[1]["ingested_at"] == "2024-01-01T00:00:00.000000+00:00"
    assert envelopes.to_envelope(df, F.current_timestamp()).first().key is None


def test_topic_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "a INT")
    envelopes.write_topic(envelopes.to_envelope(df, F.current_timestamp()), "noaa-data", path=str(tmp_path / "t"))
    stream = topics.topic_stream(spark, path=str(tmp_path / "t"))
    sinks.land_raw(stream, str(tmp_path / "raw"), str(tmp_path / "ck"), once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "raw")).first().source == "noaa"


def test_repeated_headings():
    assert text_tables.number_repeats("YR MON NINO1+2 ANOM NINO3 ANOM NINO4 ANOM NINO3.4 ANOM".split()) == list(text_tables.OCEAN_TABLE_COLUMNS)


def test_ascii_table_file(spark, tmp_path):
    (tmp_path / "t.txt").write_text(" YR   MON  NINO1+2  ANOM   NINO3  ANOM  NINO4  ANOM NINO3.4 ANOM\n2024   1  25.1  0.5 26  0.6   28.1  -0.2 27.0  0.1\n\n")
    docs = text_tables.read_lines(spark, str(tmp_path / "t.txt")).select(F.col("text").alias("json_str"))
    rows = {r.region: r for r in normalizers.ocean_indices(docs).collect()}
    assert (rows["nino_4"].sst, rows["nino_4"].anomaly, rows["nino_4"].month) == (28.1, -0.2, 1) and len(rows) == 4


TIDE = """TABLA DE MAREAS 2024
GUAYAQUIL RIO
ENERO
HORA ALTURA
LU 0101 9.9
1 0030 1.10 16 0115 2.20 1 0200 3.3 16 0245 4.4 30 0300 5.5 16 0345 6.6 1 0000 7.7
MA 0630 1.15 LU 0715 2.25
2 1230 x.y 17 99zz 1.0
XX 0000 1.0 SA 1800 2.5
SA 2400 0.1
DO 0100
"""


def test_tide_table(spark):
    docs = spark.createDataFrame([("d", 2024, 1, TIDE)], "doc STRING, year INT, quarter INT, text STRING")
    parsed = text_tables.parse_tide_tables(docs).persist()
    events = [(r.event_ts, r.height_m) for r in text_tables.tide_events(parsed).orderBy("event_ts").collect()]
    at = lambda m, d, h, mi: dt.datetime(2024, m, d, h, mi)
    assert events == [
        (at(1, 1, 0, 30), 1.1), (at(1, 1, 6, 30), 1.15), (at(1, 16, 1, 15), 2.2), (at(1, 16, 7, 15), 2.25), (at(1, 17, 18, 0), 2.5),
        (at(2, 1, 2, 0), 3.3), (at(2, 16, 2, 45), 4.4), (at(3, 16, 3, 45), 6.6), (at(3, 30, 3, 0), 5.5),
    ]
    bad = sorted((r.problem, r.line_no) for r in text_tables.tide_rejects(parsed).collect())
    # Line 4 comes before any day, line 5 has a seventh group, line 10 is cut short.
    assert bad == [("bad_date", 9), ("bad_height", 7), ("bad_layout", 4), ("bad_layout", 5), ("bad_layout", 10), ("bad_time", 7)]
    plan = text_tables.parse_tide_tables(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    assert spark.range(1).select(text_tables.month_number(F.lit("Marzo")).alias("m")).first().m == 3


def test_layers(spark, tmp_path):
    df = spark.createDataFrame([("L1", "Point", "[1.0,2.0]", {"a": "b"})], "layer STRING, geometry_type STRING, coordinates STRING, properties MAP<STRING, STRING>")
    layers.write_layers(df, str(tmp_path / "l"))
    layers.write_layers(df, str(tmp_path / "l"))
    row = layers.read_layers(spark, str(tmp_path / "l")).collect()
    assert len(row) == 1 and row[0].properties == {"a": "b"} and row[0].coordinates == "[1.0,2.0]"
    (tmp_path / "x.geojson").write_text('{"type": "FeatureCollection",\n "features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"k": 1}}]}')
    assert layers.read_geojson(spark, str(tmp_path / "x.geojson")).first().properties == {"k": "1"}


def raw(spark, *docs):
    return spark.createDataFrame([(i, json.dumps(d, ensure_ascii=False)) for i, d in enumerate(docs)], "id INT, json_str STRING")


def test_published_payloads(spark):
    day = {"date": "2024-01-01", "temperature_c": 25.5, "weather_description": "N/A"}
    assert normalizers.published(raw(spark, {"data": [day, day]}, {"data": []}, {"other": 1}), "openweathermap").count() == 2
    for source in ("gee", "open_meteo", "nasa_power", "enso_indexes", "copernicus"):
        row = normalizers.published(raw(spark, {"metadata": {"source": "s"}, "data": [{"date": "2024-01-01"}]}), source).first()
        assert row.date == "2024-01-01"
    flat = normalizers.published(raw(spark, {"canton": "Daule", "severidad": "alta"}), "sngr_alertas").first()
    assert flat.canton == "Daule" and flat.url_fuente is None
    level = normalizers.published(raw(spark, {"nivel_msnm": 80}), "celec_embalse").first()
    assert level.nivel_msnm == 80.0 and level.nivel_maximo_msnm is None


def test_ragged_archive_keeps_its_rows(spark):
    docs = raw(spark, {"daily": {"time": ["a", "b"], "temperature_2m_mean": [1.0], "precipitation_sum": [1, None]}}, {"daily": {}}, {})
    rows = normalizers.weather_archive(docs).orderBy("id", "date").collect()
    assert [(r.id, r.date, r.mean_air_temp_c, r.precipitation_sum_mm, r.is_ragged) for r in rows] == [(0, "a", 1.0, 1.0, True), (0, "b", None, None, True)]


def test_local_daily_sentinels(spark):
    docs = raw(spark, {"properties": {"parameter": {"T2M": {"20240101": 25.0, "20240102": None}, "PS": {"20240101": None}}}}, {"properties": {"parameter": {"PS": {"20240101": 1.0}}}})
    rows = normalizers.local_daily(docs).orderBy("date").collect()
    assert [(r.date, r.temperature_2m_C, r.precipitation_mm, r.surface_pressure_kPa) for r in rows] == [("20240101", 25.0, -999.0, None), ("20240102", None, -999.0, -999.0)]


def test_station_halves(spark):
    docs = raw(spark, {"estaciones": {"endpoint": "u", "error": "500"}, "pronostico_diario": {"fecha": "f", "pronostico": [{"locality_name": "Guayaquil", "rain": True, "forecast": []}]}})
    assert normalizers.stations(docs).isEmpty()
    assert normalizers.forecasts(docs).first().rain is True
    assert [(r.half, r.error) for r in normalizers.failed_halves(docs).collect()] == [("estaciones", "500")]


def test_waterways_fall_apart_by_document(spark):
    way = {"type": "way", "id": 5, "nodes": [1, 2], "tags": {"waterway": "river"}}
    a = {"elements": [{"type": "node", "id": 1, "lon": 0, "lat": 0}, {"type": "node", "id": 2, "lon": 1, "lat": 1}, way]}
    b = {"elements": [{"type": "node", "id": 1, "lon": 0, "lat": 0}, way]}
    odd = [{"elements": None}, {}, [], {"elements": [{"type": "way", "id": "x"}, 7, {"type": "way", "id": 3, "nodes": None, "tags": None}]}]
    shaped = normalizers.waterways(raw(spark, a, b, *odd).withColumnRenamed("id", "doc"), "doc")
    assert "Exchange" not in shaped._jdf.queryExecution().executedPlan().toString()
    rows = shaped.collect()
    assert rows[0].coordinates == "[[0.0,0.0],[1.0,1.0]]"
    assert [(r.doc, r.way_id, r.geometry_type, r.properties) for r in rows] == [(0, 5, "LineString", {"waterway": "river"})]


def test_snapshot_epochs_replace_themselves(spark, tmp_path):
    df = spark.createDataFrame([("Z", "n", 1.0, 2.0, 3.0, 4.0, 5.0, 0.5, "alto")], "zone_id STRING, sector_name STRING, lat DOUBLE, lon DOUBLE, rain_mm DOUBLE, tide_m DOUBLE, flow_m3s DOUBLE, risk_score DOUBLE, risk_level STRING")
    path = str(tmp_path / "s")
    for epoch in (0, 1, 1):
        sinks.write_snapshots(df, path, epoch, "2024-01-01 00:00:00")
    rows = sinks.read_snapshots(spark, path)
    assert rows.count() == 2 and dict(rows.dtypes)["risk_score"] == "double"
    assert sinks.compact_closed(spark, path, "2024-01-02") == 1
    assert len(list((tmp_path / "s_closed" / "date=2024-01-01").rglob("*.parquet"))) == 1 and sinks.read_snapshots(spark, path).count() == 2


def test_unreadable_payloads_are_set_aside(spark):
    texts = ['{"canton":"Daule"}', '{"canton":"Dau', "", None, "[1]", "null"]
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, json_str STRING")
    problems = {r.id: r.problem for r in normalizers.unreadable_payloads(df).collect()}
    assert problems == {1: "broken", 2: "missing", 3: "missing", 4: "no_object", 5: "no_object"}
    assert [r.id for r in normalizers.published(df, "sngr_alertas").collect()] == [0]
    assert normalizers.published(df, "seguraep").count() == 1


def test_satellite_keeps_days_outside_all_regions(spark):
    grid = spark.createDataFrame(
        [(dt.date(2024, 1, d), 60.0 if d == 2 else 0.0, -150.0, 100.0 * d, 10.0, 2.0) for d in range(1, 21)],
        "date DATE, lat DOUBLE, lon DOUBLE, sst DOUBLE, anom DOUBLE, rate DOUBLE")
    rows = {r.date.day: r for r in normalizers.satellite_daily(grid, grid).collect()}
    assert sorted(rows) == list(range(1, 16)) and rows[2].nino34_mean_sst is None and rows[3].nino34_mean_sst == 3.0
    ranged = normalizers.satellite_daily(grid, grid, start="2024-01-02", end="2024-01-05", n_days=None)
    assert sorted(r.date.day for r in ranged.collect()) == [2, 3, 4]


def test_ocean_model_reads_its_region_at_the_surface(spark):
    rows = [(dt.date(2024, 1, 1), 0.0, -150.0, 0.5, 1.0), (dt.date(2024, 1, 1), 60.0, -150.0, 0.5, 9.0), (dt.date(2024, 1, 1), 0.0, -150.0, 400.0, 9.0),
            (dt.date(2024, 1, 2), 60.0, 10.0, 0.5, 9.0)]
    cells = spark.createDataFrame(rows, "date DATE, lat DOUBLE, lon DOUBLE, depth DOUBLE, x DOUBLE")
    flat = cells.where("depth < 1")
    named = lambda df, *names: df.select("date", "lat", "lon", "depth", *[F.col("x").alias(c) for c in names])
    out = normalizers.ocean_model(named(flat, "zos", "mlotst"), named(cells, "thetao"), named(cells, "so"), named(cells, "uo", "vo")).orderBy("date").collect()
    assert [tuple(r)[1:] for r in out] == [(1.0,) * 6, (None,) * 6]


def test_rain_event_envelope_keeps_the_document(spark):
    feature = lambda c: {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"canton": c, "x": 1}}
    docs = raw(spark, {"data": {"type": "FeatureCollection", "features": [feature("DAULE"), feature("QUITO")]}}, {"data": {"type": "FeatureCollection", "features": []}}, {})
    rows = {r.id: r for r in normalizers.rain_event_envelope(docs).collect()}
    assert [len(rows[i].data.features) for i in range(3)] == [1, 0, 0]
    assert rows[0].data.features[0].properties == {"canton": "DAULE", "x": "1"} and rows[0].metadata.source == "SGR Eventos Lluvia"


def test_compacted_dates_are_read_once(spark, tmp_path):
    """Copies hold what was landed, late rows come from the table until the next run, nothing twice."""
    path = str(tmp_path / "s")
    schema = "zone_id STRING, sector_name STRING, lat DOUBLE, lon DOUBLE, rain_mm DOUBLE, tide_m DOUBLE, flow_m3s DOUBLE, risk_score DOUBLE, risk_level STRING"
    row = lambda z: spark.createDataFrame([(z, "n", 1.0, 2.0, 3.0, 4.0, 5.0, 0.5, "alto")], schema)

    def zones_read():
        return sorted(r.zone_id for r in sinks.read_snapshots(spark, path).collect())

    for epoch, day in enumerate(("2024-01-01", "2024-01-01", "2024-01-02", "2024-01-03")):
        sinks.write_snapshots(row(f"a{epoch}"), path, epoch, f"{day} 00:00:00", "run1")
    everything = ["a0", "a1", "a2", "a3"]
    assert zones_read() == everything
    assert sinks.compact_closed(spark, path, "2024-01-03") == 2 and zones_read() == everything
    assert len(list((tmp_path / "s_closed" / "date=2024-01-01").glob("*/*.parquet"))) == 1
    assert sinks.compact_closed(spark, path, "2024-01-03") == 0
    sinks.write_snapshots(row("late"), path, 4, "2024-01-01 09:00:00", "run1")
    sinks.write_snapshots(row("other"), path, 0, "2024-01-02 09:00:00", "run2")
    everything = sorted([*everything, "late", "other"])
    assert zones_read() == everything
    assert sinks.compact_closed(spark, path, "2024-01-03") == 2 and zones_read() == everything
    assert sinks.compact_closed(spark, path, "2024-01-04") == 1 and zones_read() == everything


def test_folders_go_after_their_copy_and_no_row_with_them(spark, tmp_path):
    df = spark.createDataFrame([("Z", "n", 1.0, 2.0, 3.0, 4.0, 5.0, 0.5, "alto")], "zone_id STRING, sector_name STRING, lat DOUBLE, lon DOUBLE, rain_mm DOUBLE, tide_m DOUBLE, flow_m3s DOUBLE, risk_score DOUBLE, risk_level STRING")
    path = str(tmp_path / "s")
    folders = lambda: len(list((tmp_path / "s").rglob("epoch_id=*")))
    for epoch, day in ((0, 1), (1, 1), (2, 2), (3, 3)):
        sinks.write_snapshots(df, path, epoch, f"2024-01-0{day} 00:00:00", "run")
    assert sinks.expire_closed(spark, path, "0 seconds") == 0  # nothing has been copied
    assert sinks.compact_closed(spark, path, "2024-01-03") == 2
    assert sinks.expire_closed(spark, path, "1 day") == 0 and folders() == 4
    assert sinks.expire_closed(spark, path, "0 seconds") == 3 and folders() == 1
    assert sinks.read_snapshots(spark, path).count() == 4 and sinks.compact_closed(spark, path, "2024-01-03") == 0
    # Late rows of a date whose folders are gone, from this run and another: the next copy holds all of them.
    sinks.write_snapshots(df, path, 4, "2024-01-01 00:00:00", "run")
    sinks.write_snapshots(df, path, 0, "2024-01-01 00:00:00", "other")
    assert sinks.read_snapshots(spark, path).count() == 6
    assert sinks.compact_closed(spark, path, "2024-01-03") == 1 and sinks.read_snapshots(spark, path).count() == 6
    assert sinks.expire_closed(spark, path, "0 seconds") == 3  # two epochs and the older copy
    assert sinks.read_snapshots(spark, path).count() == 6 and folders() == 1
    assert sinks.compact_closed(spark, path, "2024-01-09") == 1 and sinks.expire_closed(spark, path, "0 seconds") == 1
    assert folders() == 0 and sinks.read_snapshots(spark, path).count() == 6 and sinks.compact_closed(spark, path, "2024-01-09") == 0


def test_tide_tables_and_waterways_need_no_python_worker(spark):
    docs = spark.createDataFrame([("d", 2024, 1, TIDE)], "doc STRING, year INT, quarter INT, text STRING")
    plans = [text_tables.parse_tide_tables(docs), normalizers.waterways(raw(spark, {"elements": []}), "id")]
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_tide_table_documents_of_all_kinds(spark):
    rows = [("n", 2024, 1, None), ("e", 2024, 1, ""), ("q", 2024, None, "1 0030 1.10"), ("z", 2024, 0, "1 0030 1.10"), ("w", 2024, 1, "\xa01 0030 1.10\r\n  MA\t0630  1.15 "), ("big", 2024, 1, "99999999999 0030 1.0")]
    parsed = text_tables.parse_tide_tables(spark.createDataFrame(rows, "doc STRING, year INT, quarter INT, text STRING")).collect()
    assert sorted((r.doc, r.line_no, r.day, r.problem) for r in parsed if r.doc in "wz") == [("w", 0, 1, None), ("w", 1, 1, None), ("z", 0, 1, "bad_date")]
    assert {r.doc: r.problem for r in parsed if r.doc in ("n", "e", "q", "big")} == {"big": "bad_layout"}


def test_ways_with_odd_elements(spark):
    node = lambda i, lon, lat: {"type": "node", "id": i, "lon": lon, "lat": lat}
    many = [node(i, i % 180, i % 90) for i in range(5000)]
    doc = {"elements": [
        node(1, 0.5, 0), node(1, 2.5, 1), node(2, 3, 4), node(3, "x", 4), node(4.0, 1, 1), {"type": "node", "id": 5}, *many[10:],
        {"type": "way", "id": 7, "nodes": [1, 2, 99999, 3, 4.0, 5, 4999, "2", None], "tags": {"a": "b", "n": 5, "z": None, "o": {"k": [1]}}},
        {"type": "way", "id": 8, "nodes": [2, 1, 2]}, {"type": "way", "id": 9, "nodes": "x"}, {"type": "way", "id": 10, "nodes": [1, 77777]}, {"type": 5, "id": 11}, None, []]}
    rows = {r.way_id: r for r in normalizers.waterways(raw(spark, doc).withColumnRenamed("id", "doc"), "doc").collect()}
    assert set(rows) == {7, 8} and rows[8].geometry_type == "Polygon" and rows[7].geometry_type == "LineString"
    assert json.loads(rows[7].coordinates) == [[2.5, 1.0], [3.0, 4.0], [4999 % 180, 4999 % 90]]
    assert rows[7].properties == {"a": "b", "n": "5", "o": '{"k":[1]}'}
