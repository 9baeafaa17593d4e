"""Places, regions, ways and GeoJSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from floodlens.functions import geometry as geo
from floodlens.functions.scalars import explode_rows
from floodlens.operators import features, ways
from floodlens.operators.nearest import nearest_place
from floodlens.plans import views as v
from floodlens.plans.registry import query
from floodlens.session import shared_dir
from floodlens.sources.layers import read_layers, write_layers


@query("bbox_filter", """
    WITH all_nodes AS (SELECT p_partkey AS node_id, p_type, (p_partkey * 13 % 360 - 180)::DOUBLE AS lon, (p_partkey % 120 - 60)::DOUBLE AS lat FROM part)
    SELECT node_id, lat, lon FROM all_nodes
    WHERE lat BETWEEN -20 AND 30 AND lon BETWEEN -100 AND 50 AND (p_type = 'LARGE' OR p_type = 'PROMO')""")
def bbox_filter(spark, sf):
    lat, lon = v.lonlat("p_partkey", 120, 60, 13)
    tags = (
        F.when(F.col("p_type") == "LARGE", F.create_map(F.lit("waterway"), F.lit("river")))
        .when(F.col("p_type") == "PROMO", F.create_map(F.lit("natural"), F.lit("water")))
        .when(F.col("p_type") == "SMALL", F.create_map(F.lit("waterway"), F.lit("canal")))
    )
    nodes = v.table(spark, sf, "part").select(
        F.col("p_partkey").alias("node_id"), lat.alias("lat"), lon.alias("lon"), tags.alias("tags")
    )
    return ways.in_bounds(nodes, -20.0, -100.0, 30.0, 50.0).where(ways.water_tags(F.col("tags"))).select(
        "node_id", "lat", "lon"
    )


@query("nearest_safe_place", v.with_sql(v.ZONES_SQL, v.PLACES_SQL, body="""
    SELECT zone_id, place_id, place_lat, place_lon, distance_km FROM (
      SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY distance_km, place_id) AS rn FROM (
        SELECT zone_id, place_id, p.lat AS place_lat, p.lon AS place_lon,
               round(6371e0 * 2e0 * atan2(sqrt(a), sqrt(1e0 - a)), 6) AS distance_km
        FROM zones z CROSS JOIN places p, LATERAL (
          SELECT least(1e0, pow(sin((radians(p.lat) - radians(z.lat)) / 2e0), 2) + cos(radians(z.lat)) * cos(radians(p.lat)) * pow(sin((radians(p.lon) - radians(z.lon)) / 2e0), 2)) AS a)))
    WHERE rn = 1"""))
def nearest_safe_place(spark, sf):
    points = v.zones(spark, sf).select("zone_id", "lat", "lon")
    return nearest_place(points, v.places(spark, sf), keep=["zone_id"])


@query("nearest_nonzero_place", v.with_sql(v.ZONES_SQL, v.PLACES_SQL, body="""
    SELECT zones.zone_id, place_id, place_lat, place_lon, distance_km FROM zones LEFT JOIN (
      SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY distance_km, place_id) AS rn FROM (
        SELECT zone_id, place_id, p.lat AS place_lat, p.lon AS place_lon,
               round(6371e0 * 2e0 * atan2(sqrt(a), sqrt(1e0 - a)), 6) AS distance_km
        FROM (SELECT * FROM zones WHERE lat <> 0 AND lon <> 0) z CROSS JOIN (SELECT * FROM places WHERE lat <> 0 AND lon <> 0) p, LATERAL (
          SELECT least(1e0, pow(sin((radians(p.lat) - radians(z.lat)) / 2e0), 2) + cos(radians(z.lat)) * cos(radians(p.lat)) * pow(sin((radians(p.lon) - radians(z.lon)) / 2e0), 2)) AS a))) best
    ON best.zone_id = zones.zone_id AND rn = 1"""))
def nearest_nonzero_place(spark, sf):
    """Zero coordinates count as missing, of zones and of places."""
    points = v.zones(spark, sf).select("zone_id", "lat", "lon")
    return nearest_place(points, v.places(spark, sf), keep=["zone_id"], drop_zero_coords=True)


@query("way_assembly", v.with_sql(v.NODES_SQL, body="""
    , pts AS (SELECT way_id, pos, lon, lat FROM (SELECT way_id, unnest(node_ids) AS node_id, generate_subscripts(node_ids, 1) AS pos FROM ways) JOIN nodes USING (node_id)),
    g AS (SELECT way_id, list([lon, lat] ORDER BY pos) AS coords FROM pts GROUP BY way_id)
    SELECT way_id, CASE WHEN coords[1] = coords[-1] THEN 'Polygon' ELSE 'LineString' END AS geometry_type, len(coords)::INTEGER AS n_points,
           CASE WHEN coords[1] = coords[-1] THEN CAST(to_json([coords]) AS VARCHAR) ELSE CAST(to_json(coords) AS VARCHAR) END AS coordinates
    FROM g WHERE len(coords) >= 2"""))
def way_assembly(spark, sf):
    nodes, way_rows = v.nodes_and_ways(spark, sf)
    return ways.assemble_ways(way_rows, nodes)


@query("representative_point", v.with_sql(v.PLACES_SQL, body="""
    SELECT place_id, CASE WHEN place_id % 4 < 3 THEN lon END AS lon, CASE WHEN place_id % 4 < 3 THEN lat END AS lat FROM places"""))
def representative_point(spark, sf):
    pair = F.concat(F.lit("["), F.col("lon").cast("string"), F.lit(","), F.col("lat").cast("string"), F.lit("]"))
    kinds = F.array(*map(F.lit, ("Point", "Polygon", "MultiPolygon", "LineString")))
    i = (F.col("place_id") % 4).cast("int")
    coords = (
        F.when(i == 0, pair).when(i == 1, F.concat(F.lit("[["), pair, F.lit(",[0,0]]]")))
        .when(i == 2, F.concat(F.lit("[[["), pair, F.lit(",[0,0]]]]"))).otherwise(F.concat(F.lit("["), pair, F.lit(",[0,0]]")))
    )
    at = geo.representative_point(F.get(kinds, i), coords)
    return v.places(spark, sf).select("place_id", at.alias("at")).select("place_id", "at.lon", "at.lat")


def place_pages(spark, sf):
    properties = F.struct(F.col("place_id").alias("id"), F.col("name").alias("name"))
    return features.feature_collections(
        v.places(spark, sf), ["s_nationkey"], geo.point_feature("lon", "lat", properties), ["place_id"],
        F.floor(F.col("place_id") / 200).cast("long"),
    )


@query("feature_collection", v.with_sql(v.PLACES_SQL, body="""
    SELECT s_nationkey, place_id // 200 AS page, count(*) AS n_features,
           CAST(to_json({'type': 'FeatureCollection', 'features': list(
             {'type': 'Feature', 'geometry': {'type': 'Point', 'coordinates': [lon, lat]}, 'properties': {'id': place_id, 'name': name}}
             ORDER BY place_id)}) AS VARCHAR) AS collection
    FROM places GROUP BY 1, 2"""))
def feature_collection(spark, sf):
    return place_pages(spark, sf)


@query("geojson_features", v.with_sql(v.PLACES_SQL, body="""
    SELECT s_nationkey::VARCHAR AS layer, place_id::VARCHAR AS id, name, 'Point' AS geometry_type,
           '[' || lon || ',' || lat || ']' AS coordinates FROM places"""))
def geojson_features(spark, sf):
    """Collection pages unfolded into features, landed as layers and read back."""
    pages = place_pages(spark, sf).select(F.col("s_nationkey").cast("string").alias("layer"), F.col("collection").alias("json_str"))
    path = shared_dir(spark, "layers")
    write_layers(features.explode_features(pages, keep=["layer"]), path)
    return read_layers(spark, path).select(
        F.col("layer").cast("string").alias("layer"),
        F.col("properties")["id"].alias("id"), F.col("properties")["name"].alias("name"), "geometry_type", "coordinates",
    )


_REGION_RINGS = """
    SELECT region, '[[' || west || ',' || south || '],[' || east || ',' || south || '],[' || east || ',' || north || '],[' || west || ',' || north || '],[' || west || ',' || south || ']]' AS ring,
           west FROM regions"""


@query("region_outlines", v.with_sql(v.REGIONS_SQL, v.GRID_SQL, body=f"""
    SELECT o.region, ring, count(*) AS n_cells FROM ({_REGION_RINGS.replace('west FROM', 'west::DOUBLE AS west, south, east, north FROM')}) o
    JOIN grid ON lat BETWEEN south AND north AND lon BETWEEN west AND east GROUP BY 1, 2""".replace(
    "|| west ||", "|| west::DOUBLE ||").replace("|| east ||", "|| east::DOUBLE ||").replace(
    "|| south ||", "|| south::DOUBLE ||").replace("|| north ||", "|| north::DOUBLE ||")))
def region_outlines(spark, sf):
    """Outline ring of each region box with the number of grid cells inside."""
    per_box = F.array(*[
        F.struct(F.lit(b.region).alias("region"), F.to_json(geo.box_ring(b)).alias("ring"), geo.in_box("lat", "lon", b).alias("hit"))
        for b in geo.OCEAN_REGIONS
    ])
    return (
        explode_rows(v.grid(spark, sf), [], F.filter(per_box, lambda b: b["hit"]))
        .groupBy("region", "ring").agg(F.count(F.lit(1)).alias("n_cells"))
    )


@query("feature_enrich", """
    SELECT p_partkey, CASE p_type WHEN 'LARGE' THEN '#38bdf8' WHEN 'SMALL' THEN 'rgba(64, 224, 208, 0.5)' WHEN 'PROMO' THEN '#ef4444' END AS color,
           CASE WHEN p_type = 'LARGE' AND p_size > 10 THEN 'Distrito ' || p_size
                WHEN p_type <> 'ECONOMY' THEN p_name END AS name
    FROM part""")
def feature_enrich(spark, sf):
    t = F.col("p_type")
    layer = (
        F.when(t == "LARGE", "sgr_sectores_celestes").when(t == "SMALL", "sgr_zonas_inundables")
        .when(t == "PROMO", "sgr_vias_inundables").otherwise("sgr_zonas_seguras")
    )
    district = F.when(F.col("p_size") > 10, F.col("p_size").cast("string")).otherwise(F.lit(""))
    props = F.when(t != "ECONOMY", F.create_map(F.lit("name"), F.col("p_name"), F.lit("DISTRITO"), district))
    rows = features.enrich_features(
        v.table(spark, sf, "part").select("p_partkey", layer.alias("layer"), props.alias("properties"))
    )
    prop = lambda k: F.try_element_at("properties", F.lit(k))
    return rows.select("p_partkey", prop("color").alias("color"), prop("name").alias("name"))


@query("geodesic_disc", v.with_sql(v.ZONES_SQL, body="""
    SELECT zone_id, k AS vertex, round(degrees(lam + atan2(sin(b) * sin(d) * cos(phi), cos(d) - sin(phi) * sin(lat2))), 6) AS lon,
           round(degrees(lat2), 6) AS lat
    FROM (SELECT *, asin(sin(phi) * cos(d) + cos(phi) * sin(d) * cos(b)) AS lat2
          FROM (SELECT zone_id, k::INTEGER AS k, radians(lat) AS phi, radians(lon) AS lam, 1.5e0 / 6371e0 AS d, 2e0 * pi() * (k % 16) / 16e0 AS b
                FROM zones, (SELECT unnest(range(17)) AS k)))"""))
def geodesic_disc(spark, sf):
    discs = v.zones(spark, sf).select("zone_id", F.posexplode(geo.geodesic_disc("lat", "lon", 1.5, 16)).alias("vertex", "at"))
    return discs.select(
        "zone_id", "vertex", F.round(F.get("at", F.lit(0)), 6).alias("lon"), F.round(F.get("at", F.lit(1)), 6).alias("lat")
    )
