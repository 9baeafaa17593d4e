"""GeoJSON collections: rows to documents, documents to rows, enrichment, property lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodlens.functions.scalars import explode_rows, unwrap_data
from floodlens.schemas import FEATURE_COLLECTION_SCHEMA

# Fill colour per layer, and the layer whose features get a district name.
LAYER_COLORS = {
    "sgr_sectores_celestes": "#38bdf8",
    "sgr_zonas_inundables": "rgba(64, 224, 208, 0.5)",
    "sgr_vias_inundables": "#ef4444",
}
DISTRICT_LAYER, DISTRICT_KEY, DISTRICT_PREFIX = "sgr_sectores_celestes", "DISTRITO", "Distrito "
LAYERS = (*LAYER_COLORS, "sgr_zonas_seguras", "sgr_zonas_vulnerables_marea_alta")


def feature_collections(
    df: DataFrame, group: Sequence[str], feature: Column, order_by: Sequence[str], page: Column
) -> DataFrame:
    """One FeatureCollection document per group and page, features in order.

    ``page`` keeps a document bounded: a group of any size becomes as many documents as it needs,
    and :func:`explode_features` puts them together again.
    """
    rows = df.select(*group, page.alias("page"), F.struct(*order_by, feature.alias("__feature")).alias("__entry"))
    ordered = F.transform(F.array_sort(F.collect_list("__entry")), lambda e: e["__feature"])
    document = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), ordered.alias("features")))
    return rows.groupBy(*group, "page").agg(
        document.alias("collection"), F.count(F.lit(1)).alias("n_features")
    )


def hashed_page(df: DataFrame, group: Sequence[str], by: Sequence[str], page_size: int) -> DataFrame:
    """Add ``page``: rows of a group spread by hash over as many pages as its count needs.

    The counts combine map-side; no group is ever sorted or numbered as a whole.
    """
    sizes = df.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / F.lit(page_size)).alias("__pages"))
    spread = F.pmod(F.xxhash64(*by), F.col("__pages"))
    return df.join(sizes, list(group)).withColumn("page", spread).drop("__pages")


def explode_features(documents: DataFrame, json: str = "json_str", keep: Sequence[str] = ()) -> DataFrame:
    """One row per feature; pages of a layer concatenate, empty pages add nothing."""
    parsed = F.from_json(unwrap_data(json), FEATURE_COLLECTION_SCHEMA)
    return explode_rows(documents, keep, parsed["features"]).select(
        *keep,
        F.col("geometry.type").alias("geometry_type"),
        F.col("geometry.coordinates").alias("coordinates"),
        "properties",
    )


def enrich_features(features: DataFrame, layer: str = "layer", properties: str = "properties") -> DataFrame:
    """Add the layer's colour, and a name where the district layer carries a district."""
    props = F.coalesce(F.col(properties), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    color = None
    for name, value in LAYER_COLORS.items():
        hit = F.col(layer) == name
        color = F.when(hit, F.lit(value)) if color is None else color.when(hit, F.lit(value))
    district = F.nullif(F.try_element_at(props, F.lit(DISTRICT_KEY)), F.lit(""))
    name = F.when(F.col(layer) == DISTRICT_LAYER, F.concat(F.lit(DISTRICT_PREFIX), district))

    def put(base: Column, key: str, value: Column) -> Column:
        without = F.map_filter(base, lambda k, _: k != F.lit(key))
        return F.when(value.isNotNull(), F.map_concat(without, F.create_map(F.lit(key), value))).otherwise(base)

    return features.withColumn(properties, put(put(props, "color", color), "name", name))


def lookup_property(properties: Column | str, names: Sequence[str], containing: str | None = None) -> Column:
    """First non-empty property among ``names``, else that of the first key holding ``containing``."""
    props = F.col(properties) if isinstance(properties, str) else properties
    found = [F.nullif(F.try_element_at(props, F.lit(n)), F.lit("")) for n in names]
    if containing is not None:
        matching = F.filter(F.map_entries(props), lambda e: F.contains(e["key"], F.lit(containing)))
        found.append(F.nullif(F.get(matching, F.lit(0))["value"], F.lit("")))
    return F.coalesce(*found)


def safe_zone_card(features: DataFrame, properties: str = "properties") -> DataFrame:
    """Number, place, location and usable area of each safe zone with their display defaults."""
    return features.select(
        "*",
        F.coalesce(lookup_property(properties, ["N_ZONA"]), F.lit("N/A")).alias("zone_number"),
        F.coalesce(lookup_property(properties, ["N_LUGAR"]), F.lit("Desconocido")).alias("place"),
        F.coalesce(
            lookup_property(properties, ["UBICACIÓN", "UBICACION"], "UBICACI"), F.lit("Desconocida")
        ).alias("location"),
        F.coalesce(lookup_property(properties, ["AREA_UTI_1", "AREA_UTIL"]), F.lit("N/A")).alias("usable_area"),
    )
