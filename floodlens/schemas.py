"""Explicit schemas. Nothing in this package relies on inference."""

from __future__ import annotations


# Column order of the zone file; the reader renames to the English names used everywhere else.
ZONE_FILE_SCHEMA = (
    "zona_id STRING, nombre_sector STRING, lat_centroide DOUBLE, lon_centroide DOUBLE, "
    "cota_media_msnm DOUBLE, pendiente_clase STRING, historicamente_inundable STRING, "
    "cercania_estero_m DOUBLE"
)
ZONE_COLUMNS = {
    "zona_id": "zone_id",
    "nombre_sector": "sector_name",
    "lat_centroide": "lat",
    "lon_centroide": "lon",
    "cota_media_msnm": "elevation_m",
    "pendiente_clase": "slope_class",
    "historicamente_inundable": "flood_history",
    "cercania_estero_m": "channel_m",
}

SNAPSHOT_COLUMNS = (
    "zone_id", "sector_name", "lat", "lon", "rain_mm", "tide_m", "flow_m3s",
    "risk_score", "risk_level", "computed_at", "date",
)

# Topic -> source folder. The ocean-model topic is produced but was never subscribed;
# it is part of the map here.
TOPIC_SOURCES = {
    "gee-data": "gee",
    "noaa-data": "noaa",
    "open-meteo-data": "open_meteo",
    "nasa-power-data": "nasa_power",
    "openweathermap-data": "openweathermap",
    "enso-indexes": "enso_indexes",
    "copernicus-data": "copernicus",
    "inamhi-data": "inamhi",
    "sgr-eventos": "sgr_eventos",
    "seguraep-layers": "seguraep",
    "guayas-osm": "guayas_osm",
    "nivel-embalse-celec": "celec_embalse",
    "mareas-inocar": "inocar_mareas",
    "alertas-sngr": "sngr_alertas",
    "ndbc-buoys": "ndbc_buoys",
}

# File names of the read API -> source folder.
FILE_SOURCES = {
    "gee_data.json": "gee",
    "noaa_data.json": "noaa",
    "open_meteo_data.json": "open_meteo",
    "nasa_power_data.json": "nasa_power",
    "enso_indexes.json": "enso_indexes",
    "inocar_data.json": "inocar_mareas",
    "inamhi_data.json": "inamhi",
    "openweathermap_data.json": "openweathermap",
    "sgr_eventos.json": "sgr_eventos",
    "guayas_osm.geojson": "guayas_osm",
    "ndbc_buoys.json": "ndbc_buoys",
}

FEATURE_COLLECTION_SCHEMA = (
    "type STRING, features ARRAY<STRUCT<type STRING, "
    "geometry STRUCT<type STRING, coordinates STRING>, properties MAP<STRING, STRING>>>"
)

# Inner layout of the published payloads, one entry per source.
PAYLOAD_SCHEMAS = {
    "noaa": (
        "metadata STRUCT<source: STRING, timestamp: STRING>, data ARRAY<STRUCT<year: INT, month: INT, "
        "regions: STRUCT<nino_1_2: STRUCT<sst: DOUBLE, anomaly: DOUBLE>, nino_3: STRUCT<sst: DOUBLE, anomaly: DOUBLE>, "
        "nino_4: STRUCT<sst: DOUBLE, anomaly: DOUBLE>, nino_3_4: STRUCT<sst: DOUBLE, anomaly: DOUBLE>>>>"
    ),
    "gee": (
        "data ARRAY<STRUCT<date: STRING, nino34_mean_sst: DOUBLE, nino34_mean_anomaly: DOUBLE, "
        "nino12_mean_sst: DOUBLE, nino12_mean_anomaly: DOUBLE, nino3_mean_sst: DOUBLE, nino3_mean_anomaly: DOUBLE, "
        "nino4_mean_sst: DOUBLE, nino4_mean_anomaly: DOUBLE, coast_precipitation_mm: DOUBLE>>"
    ),
    "open_meteo": (
        "data ARRAY<STRUCT<date: STRING, mean_air_temp_c: DOUBLE, precipitation_sum_mm: DOUBLE, "
        "max_wind_speed_ms: DOUBLE, dominant_wind_direction_deg: DOUBLE, shortwave_radiation_mj_m2: DOUBLE>>"
    ),
    "nasa_power": (
        "data ARRAY<STRUCT<date: STRING, temperature_2m_C: DOUBLE, precipitation_mm: DOUBLE, "
        "wind_speed_10m_ms: DOUBLE, wind_direction_10m_deg: DOUBLE, solar_radiation_MJ_m2: DOUBLE, "
        "surface_pressure_kPa: DOUBLE>>"
    ),
    "openweathermap": (
        "data ARRAY<STRUCT<date: STRING, temperature_c: DOUBLE, humidity: DOUBLE, pressure_hpa: DOUBLE, "
        "wind_speed_ms: DOUBLE, weather_description: STRING, clouds_percent: DOUBLE>>"
    ),
    "enso_indexes": (
        "data ARRAY<STRUCT<date: STRING, tahiti_mslp_hpa: DOUBLE, darwin_mslp_hpa: DOUBLE, "
        "soi_proxy_diff: DOUBLE, enso_status: STRING>>"
    ),
    "copernicus": (
        "data ARRAY<STRUCT<date: STRING, zos_meters: DOUBLE, mlotst_meters: DOUBLE, thetao_degC: DOUBLE, "
        "so_psu: DOUBLE, uo_velocity_m_s: DOUBLE, vo_velocity_m_s: DOUBLE>>"
    ),
    "inamhi": (
        "estaciones STRUCT<total_estaciones: INT, error: STRING, estaciones: ARRAY<STRUCT<punto_obs: STRING, "
        "canton: STRING, categoria: STRING, estado_transmision: STRING, altitud: DOUBLE>>>, "
        "pronostico_diario STRUCT<fecha: STRING, total_localidades: INT, error: STRING, "
        "pronostico: ARRAY<STRUCT<locality_name: STRING, min_temperature: DOUBLE, max_temperature: DOUBLE, "
        "uv_radiation: DOUBLE, rain: BOOLEAN, precipitacion_mm: DOUBLE, "
        "forecast: ARRAY<STRUCT<period_name: STRING, condition_name: STRING, condition_icon_url: STRING>>>>>"
    ),
    "celec_embalse": (
        "fuente STRING, embalse STRING, descripcion STRING, url_fuente STRING, fecha_noticia STRING, "
        "nivel_msnm DOUBLE, nivel_maximo_msnm DOUBLE"
    ),
    "inocar_mareas": (
        "fuente STRING, puerto STRING, altura_marea_m DOUBLE, tendencia STRING, pleamar BOOLEAN"
    ),
    "sngr_alertas": (
        "fuente STRING, canton STRING, tipo_evento STRING, severidad STRING, descripcion STRING, "
        "url_fuente STRING, hora_evento STRING"
    ),
    "ndbc_buoys": FEATURE_COLLECTION_SCHEMA,
    "seguraep": FEATURE_COLLECTION_SCHEMA,
    "sgr_eventos": f"data STRUCT<{FEATURE_COLLECTION_SCHEMA.replace('type STRING, features', 'type: STRING, features:')}>",
    "guayas_osm": f"data STRUCT<{FEATURE_COLLECTION_SCHEMA.replace('type STRING, features', 'type: STRING, features:')}>",
}
