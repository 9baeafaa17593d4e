"""Per-source normalisers: JSON text of the raw zone into typed rows.

``published`` reads the payload each source puts on its topic. The other functions start from the
upstream shape (parallel arrays, maps of maps, element lists, web posts) where turning it into rows
is the work. Every column of the input other than the text is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodlens.functions.geometry import OCEAN_REGIONS, Box, in_box, point_feature
from floodlens.functions.scalars import explode_rows, falsy_to, pressure_phase
from floodlens.operators import bulletins
from floodlens.operators.features import enrich_features, explode_features, feature_collections
from floodlens.operators.grids import between_days, daily_region_rain, first_days, region_daily_mean, surface_only, with_daily_rain
from floodlens.operators.payloads import align_params, merge_daily, pair_difference, unpivot_regions, zip_rows
from floodlens.operators.series import bracket, tide_with_fallback
from floodlens.operators.ways import document_ways
from floodlens.schemas import FEATURE_COLLECTION_SCHEMA, PAYLOAD_SCHEMAS
from floodlens.session import ensure_checkpoint_dir
from floodlens.sources.text_tables import OCEAN_TABLE_COLUMNS, document_lines, parse_blank_table, parse_tide_tables, tide_events

POST_SCHEMA = (
    "title STRUCT<rendered: STRING>, excerpt STRUCT<rendered: STRING>, content STRUCT<rendered: STRING>, "
    "link STRING, date_gmt STRING"
)

# Region of the ocean-model request.
OCEAN_MODEL_REGION = Box("nino34", -170.0, -5.0, -120.0, 5.0)

# Origins and reservoir named in published records, and the port of the tide tables.
RESERVOIR_ORIGIN, RESERVOIR = "CELEC_wp_api", "Daule-Peripa"
ALERT_ORIGIN = "SNGR_wp_api"
TIDE_PORT = "Guayaquil"

# Cantons of the rain-event service.
EVENT_CANTONS = ("GUAYAQUIL", "DAULE", "SAMBORONDON", "DURAN")

# Upstream names -> published names.
WEATHER_ARRAYS = {
    "mean_air_temp_c": "temperature_2m_mean",
    "precipitation_sum_mm": "precipitation_sum",
    "max_wind_speed_ms": "wind_speed_10m_max",
    "dominant_wind_direction_deg": "wind_direction_10m_dominant",
    "shortwave_radiation_mj_m2": "shortwave_radiation_sum",
}
LOCAL_PARAMETERS = {
    "precipitation_mm": "PRECTOTCORR",
    "wind_speed_10m_ms": "WS10M",
    "wind_direction_10m_deg": "WD10M",
    "solar_radiation_MJ_m2": "ALLSKY_SFC_SW_DWN",
    "surface_pressure_kPa": "PS",
}
LOCAL_DRIVER = ("T2M", "temperature_2m_C")


def _keep(raw: DataFrame) -> list[str]:
    return [c for c in raw.columns if c != "json_str"]


def _parsed(raw: DataFrame, schema: str) -> DataFrame:
    return raw.select(*_keep(raw), F.from_json("json_str", schema).alias("r")).select(*_keep(raw), "r.*")


def _readable(text: str = "json_str") -> Column:
    """Whether a text is a JSON object."""
    return F.coalesce(F.expr(f"schema_of_variant(try_parse_json({text}))").startswith("OBJECT"), F.lit(False))


def published(raw: DataFrame, source: str) -> DataFrame:
    """Rows of a published payload: one per ``data`` element, or the flat record itself.

    Texts that are no JSON object give no row; :func:`unreadable_payloads` has them.
    """
    schema = PAYLOAD_SCHEMAS[source]
    if "data ARRAY" in schema:
        return explode_rows(_parsed(raw, schema), _keep(raw), F.col("data"))
    return _parsed(raw.where(_readable()), schema)


def unreadable_payloads(raw: DataFrame, source: str | None = None) -> DataFrame:
    """Payloads that no normaliser can read, whole, with a ``problem``: ``missing``, ``broken`` or ``no_object``.

    ``source`` restricts a raw table that has that column.
    """
    rows = raw if source is None else raw.where(F.col("source") == source)
    problem = (
        F.when(F.col("json_str").isNull() | (F.btrim("json_str") == ""), "missing")
        .when(F.expr("try_parse_json(json_str)").isNull(), "broken")
        .when(~_readable(), "no_object")
    )
    return rows.withColumn("problem", problem).where(F.col("problem").isNotNull())


def ocean_indices(documents: DataFrame, text: str = "json_str") -> DataFrame:
    """Monthly index table (text) into one row per month and region."""
    keep = [c for c in documents.columns if c != text]
    table = parse_blank_table(document_lines(documents, text, keep), OCEAN_TABLE_COLUMNS, keep=keep)
    cell = {name: F.col(f"`{name}`") for name in OCEAN_TABLE_COLUMNS}
    months = table.select(
        *keep, cell["YR"].cast("int").alias("year"), cell["MON"].cast("int").alias("month"),
        *[cell[c].alias(c.replace(".", "_").replace("+", "_")) for c in OCEAN_TABLE_COLUMNS[2:]],
    )
    regions = {
        "nino_1_2": (F.col("NINO1_2"), F.col("ANOM")),
        "nino_3": (F.col("NINO3"), F.col("ANOM_1")),
        "nino_4": (F.col("NINO4"), F.col("ANOM_2")),
        "nino_3_4": (F.col("NINO3_4"), F.col("ANOM_3")),
    }
    return unpivot_regions(months, [*keep, "year", "month"], regions)


def ocean_index_payload(raw: DataFrame) -> DataFrame:
    """Published nested regions into one row per month and region."""
    months = published(raw, "noaa")
    names = ("nino_1_2", "nino_3", "nino_4", "nino_3_4")
    return unpivot_regions(
        months, [*_keep(raw), "year", "month"],
        {n: (F.col(f"regions.{n}.sst"), F.col(f"regions.{n}.anomaly")) for n in names},
    )


def satellite_daily(
    grid: DataFrame, rain_rates: DataFrame, rain_box: Box = OCEAN_REGIONS[0], start=None, end=None, n_days: int | None = 15
) -> DataFrame:
    """Region means of SST and anomaly side by side, one row per image day, with coastal rain.

    The days are those of the grid from ``start`` up to but not including ``end``, the first
    ``n_days`` of them (all if None). A day without a cell in a region has NULL there.
    """
    grid = between_days(grid, "date", start, end)
    if n_days is not None:
        grid = first_days(grid, "date", n_days)
    days = grid.select("date").distinct()
    means = region_daily_mean(grid, {"sst": 100.0, "anom": 100.0})
    regions = ("nino34", "nino12", "nino3", "nino4")
    wide = means.groupBy("date").agg(*[
        F.max(F.when(F.col("region") == r, F.col(f"mean_{v}"))).alias(f"{r}_mean_{name}")
        for r in regions for v, name in (("sst", "sst"), ("anom", "anomaly"))
    ])
    return with_daily_rain(days.join(wide, "date", "left"), daily_region_rain(rain_rates, rain_box)).withColumnRenamed(
        "rain_mm", "coast_precipitation_mm"
    )


def weather_archive(raw: DataFrame) -> DataFrame:
    """Parallel daily arrays into daily rows."""
    arrays = ", ".join(f"{name}: ARRAY<DOUBLE>" for name in WEATHER_ARRAYS.values())
    rows = _parsed(raw, f"daily STRUCT<time: ARRAY<STRING>, {arrays}>").select(*_keep(raw), "daily.*")
    return zip_rows(rows, "time", WEATHER_ARRAYS, _keep(raw)).withColumnRenamed("time", "date").drop("pos")


def local_daily(raw: DataFrame) -> DataFrame:
    """Map of maps into daily rows driven by temperature; gaps carry the sentinel."""
    rows = _parsed(raw, "properties STRUCT<parameter: MAP<STRING, MAP<STRING, DOUBLE>>>")
    code, name = LOCAL_DRIVER
    maps = [
        F.try_element_at(F.col("properties.parameter"), F.lit(c)).alias(c) for c in (code, *LOCAL_PARAMETERS.values())
    ]
    return align_params(rows.select(*_keep(raw), *maps), code, LOCAL_PARAMETERS, _keep(raw)).withColumnRenamed(code, name)


def current_weather(raw: DataFrame, date: Column) -> DataFrame:
    """Nested current conditions into one row; the description has a default, the rest may be NULL."""
    rows = _parsed(
        raw,
        "main STRUCT<temp: DOUBLE, humidity: DOUBLE, pressure: DOUBLE>, wind STRUCT<speed: DOUBLE>, "
        "weather ARRAY<STRUCT<description: STRING>>, clouds STRUCT<all: DOUBLE>",
    )
    return rows.select(
        *_keep(raw),
        F.date_format(date, "yyyy-MM-dd").alias("date"),
        F.col("main.temp").alias("temperature_c"),
        F.col("main.humidity").alias("humidity"),
        F.col("main.pressure").alias("pressure_hpa"),
        F.col("wind.speed").alias("wind_speed_ms"),
        F.when(F.size("weather") > 0, F.get("weather", F.lit(0))["description"]).otherwise("N/A").alias("weather_description"),
        F.col("clouds.all").alias("clouds_percent"),
    )


def pressure_index(readings: DataFrame) -> DataFrame:
    """Tahiti minus Darwin per date with the phase; a date needs both stations."""
    pairs = pair_difference(readings, "station", "tahiti", "darwin", "pressure_msl", ["date"])
    return pairs.select(
        "date",
        F.col("first_value").alias("tahiti_mslp_hpa"),
        F.col("second_value").alias("darwin_mslp_hpa"),
        F.col("difference").alias("soi_proxy_diff"),
        pressure_phase("difference").alias("enso_status"),
    )


def ocean_model(
    surface: DataFrame, temperature: DataFrame, salinity: DataFrame, currents: DataFrame, box: Box = OCEAN_MODEL_REGION
) -> DataFrame:
    """Four gridded datasets into one row for each of the five newest days of the surface dataset.

    Means are over the cells of ``box``; the datasets with a ``depth`` count at their shallowest only.
    """
    inside = in_box("lat", "lon", box)
    # Cells outside the box still name the days that the dataset has.
    surface = surface.select("date", *[F.when(inside, F.col(c)).alias(c) for c in ("zos", "mlotst")])

    def top(df: DataFrame) -> DataFrame:
        return surface_only(df).where(inside)

    return merge_daily(
        surface,
        [
            (top(temperature), {"thetao": "thetao_degC"}),
            (top(salinity), {"so": "so_psu"}),
            (top(currents), {"uo": "uo_velocity_m_s", "vo": "vo_velocity_m_s"}),
        ],
        {"zos": "zos_meters", "mlotst": "mlotst_meters"},
    )


def stations(raw: DataFrame) -> DataFrame:
    """Station rows of the payloads whose station half arrived."""
    rows = _parsed(raw, PAYLOAD_SCHEMAS["inamhi"])
    arrived = rows.where(F.col("estaciones.error").isNull())
    return explode_rows(arrived, _keep(raw), F.col("estaciones.estaciones"))


def forecasts(raw: DataFrame) -> DataFrame:
    """Forecast rows per locality of the payloads whose forecast half arrived."""
    rows = _parsed(raw, PAYLOAD_SCHEMAS["inamhi"])
    arrived = rows.where(F.col("pronostico_diario.error").isNull()).withColumn(
        "forecast_date", F.col("pronostico_diario.fecha")
    )
    return explode_rows(arrived, [*_keep(raw), "forecast_date"], F.col("pronostico_diario.pronostico"))


def station_counts(raw: DataFrame) -> DataFrame:
    """Stations and localities of each payload: as its producer counted them, and as they are in it.

    NULL for a half that failed.
    """
    rows = _parsed(raw, PAYLOAD_SCHEMAS["inamhi"])

    def of(half: str, value: Column) -> Column:
        return F.when(F.col(f"{half}.error").isNull(), value)

    def length(items: str) -> Column:
        return F.when(F.col(items).isNotNull(), F.size(items))

    return rows.select(
        *_keep(raw),
        of("estaciones", F.col("estaciones.total_estaciones")).alias("total_estaciones"),
        of("estaciones", length("estaciones.estaciones")).alias("n_estaciones"),
        of("pronostico_diario", F.col("pronostico_diario.total_localidades")).alias("total_localidades"),
        of("pronostico_diario", length("pronostico_diario.pronostico")).alias("n_localidades"),
    )


def tide_records(documents: DataFrame, probes: DataFrame, ts: str = "ts", port: str = TIDE_PORT) -> DataFrame:
    """Published tide records for the instants of ``probes``, from printed tables of one port.

    The height is interpolated between the printed events around the instant; without both, the
    harmonic model answers and is named as the origin. The events, which several steps read, are
    written to the checkpoint folder once.
    """
    ensure_checkpoint_dir(documents.sparkSession)
    events = tide_events(parse_tide_tables(documents)).select(F.lit(port).alias("puerto"), F.col("event_ts").alias(ts), "height_m").checkpoint()
    around = bracket(probes.withColumn("puerto", F.lit(port)), events, "puerto", ts=ts)
    return tide_with_fallback(around, ts).select(
        *probes.columns, F.col("origin").alias("fuente"), "puerto", F.col("height_m").alias("altura_marea_m"),
        F.col("trend").alias("tendencia"), F.col("high_tide").alias("pleamar"),
    )


def failed_halves(raw: DataFrame) -> DataFrame:
    """Payload halves that carry an error instead of data."""
    half = F.explode(F.array(*[
        F.struct(F.lit(name).alias("half"), F.get_json_object("json_str", f"$.{name}.error").alias("error"))
        for name in ("estaciones", "pronostico_diario")
    ]))
    return raw.select(*_keep(raw), half.alias("h")).select(*_keep(raw), "h.*").where(F.col("error").isNotNull())


def reservoir_posts(raw: DataFrame) -> DataFrame:
    """Web posts into reservoir records."""
    posts = _parsed(raw, POST_SCHEMA)
    keep = [*_keep(raw), "link", "date_gmt"]
    return bulletins.reservoir_levels(
        posts, F.col("title.rendered"), F.col("excerpt.rendered"), F.col("content.rendered"), keep
    ).select(
        *_keep(raw), F.lit(RESERVOIR_ORIGIN).alias("fuente"), F.lit(RESERVOIR).alias("embalse"),
        F.col("description").alias("descripcion"), F.col("link").alias("url_fuente"),
        F.col("date_gmt").alias("fecha_noticia"), F.col("level_m").alias("nivel_msnm"),
        F.col("max_level_m").alias("nivel_maximo_msnm"),
    )


def alert_posts(raw: DataFrame) -> DataFrame:
    """Web posts into alert records."""
    posts = _parsed(raw, POST_SCHEMA)
    keep = [*_keep(raw), "link", "date_gmt"]
    return bulletins.alerts(
        posts, F.col("title.rendered"), F.col("excerpt.rendered"), F.col("content.rendered"), keep
    ).select(
        *_keep(raw), F.lit(ALERT_ORIGIN).alias("fuente"), "canton", F.col("event_type").alias("tipo_evento"),
        F.col("severity").alias("severidad"), F.col("description").alias("descripcion"),
        F.col("link").alias("url_fuente"), F.col("date_gmt").alias("hora_evento"),
    )


def buoy_collection(buoys: DataFrame, group: list[str], page: Column) -> DataFrame:
    """Buoy rows into FeatureCollection documents."""
    properties = F.struct("id", "name", "water_temp_c", "wave_height_m", "current_velocity_kmh")
    return feature_collections(buoys, group, point_feature("lon", "lat", properties), ["id"], page)


def rain_events(raw: DataFrame, cantons: tuple[str, ...] = EVENT_CANTONS) -> DataFrame:
    """Rain-event features of the chosen cantons with their display defaults."""
    rows = explode_features(raw, keep=_keep(raw))
    prop = lambda k: F.try_element_at(F.col("properties"), F.lit(k))
    return rows.where(prop("canton").isin(list(cantons))).select(
        *_keep(raw), "geometry_type", "coordinates",
        falsy_to(prop("evento"), "Evento SGR").alias("event"),
        falsy_to(prop("fechadelevento"), "N/A").alias("event_date"),
        falsy_to(prop("canton"), "N/A").alias("canton"),
        falsy_to(prop("personasafectadasdirectamente"), "0").alias("people_affected"),
        falsy_to(prop("descripciongeneraldeevento"), "").alias("details"),
    )


def rain_event_envelope(raw: DataFrame, cantons: tuple[str, ...] = EVENT_CANTONS) -> DataFrame:
    """The published record: the collection with the features of the chosen cantons only, in its envelope.

    A document stays one row; the other properties of its features are kept.
    """
    schema = FEATURE_COLLECTION_SCHEMA.replace("type STRING, features", "type: STRING, features:")
    rows = _parsed(raw, f"data STRUCT<{schema}>")
    chosen = F.filter("data.features", lambda f: F.try_element_at(f["properties"], F.lit("canton")).isin(list(cantons)))
    return rows.select(
        *_keep(raw), F.struct(F.lit("SGR Eventos Lluvia").alias("source")).alias("metadata"),
        F.struct(F.col("data.type").alias("type"), F.coalesce(chosen, F.array()).alias("features")).alias("data"),
    )


def waterways(raw: DataFrame, doc: str) -> DataFrame:
    """Element lists (nodes and ways) into line and polygon features per document.

    Every node that a way names is in the same document, so a document is shaped where it is read.
    """
    rows = document_ways(raw, "json_str", [doc])
    closed = F.get("points", F.lit(0)) == F.element_at("points", -1)
    return rows.select(
        doc, "way_id", F.when(closed, F.lit("Polygon")).otherwise(F.lit("LineString")).alias("geometry_type"), F.size("points").alias("n_points"),
        F.when(closed, F.to_json(F.array("points"))).otherwise(F.to_json("points")).alias("coordinates"), "properties",
    )


def layer_pages(raw: DataFrame) -> DataFrame:
    """Pages of layers (column ``layer``) into enriched feature rows."""
    return enrich_features(explode_features(raw, keep=_keep(raw)))
