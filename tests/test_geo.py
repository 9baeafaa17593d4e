"""Nearest place, ways, regions and GeoJSON against brute force."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from floodlens.functions import geometry as geo
from floodlens.operators import features, grids, ways
from floodlens.operators.nearest import nearest_place


def km(a, b):
    lat1, lon1, lat2, lon2 = map(math.radians, (*a, *b))
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
    return 6371 * 2 * math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h)))


def world(rng, n, cluster):
    """A third in one cluster, a third copies of few spots, the rest anywhere incl. poles and the date line."""
    out = []
    for i in range(n):
        kind = i % 3
        if kind == 0:
            out.append((cluster[0] + rng.gauss(0, 0.002), cluster[1] + rng.gauss(0, 0.002)))
        elif kind == 1:
            out.append(rng.choice([(0.0, 180.0), (0.0, -180.0), (90.0, 0.0), (-90.0, 10.0), (-2.19, -79.88)]))
        else:
            out.append((math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)))
    return out


@pytest.mark.parametrize("depth", [1, 2, 7])
def test_nearest_against_brute_force(spark, depth):
    rng = random.Random(depth)
    places = [(i, *p) for i, p in enumerate(world(rng, 240, (10.0, 20.0)))]
    points = [(i, *p) for i, p in enumerate(world(rng, 300, (10.01, 20.03)))]
    got = {r.pt: r for r in nearest_place(
        spark.createDataFrame(points, "pt INT, lat DOUBLE, lon DOUBLE"),
        spark.createDataFrame(places, "place_id INT, lat DOUBLE, lon DOUBLE"), depth=depth,
    ).collect()}
    assert len(got) == len(points)
    for pt, lat, lon in points:
        best = min((round(km((lat, lon), p[1:]), 6), p[0]) for p in places)
        assert abs(got[pt].distance_km - best[0]) <= 2e-6
        assert abs(km((lat, lon), places[got[pt].place_id][1:]) - best[0]) <= 2e-6


def test_nearest_on_a_circle_around_a_cluster(spark):
    """All places are almost equally far from all points; the answer is exact all the same."""
    rng = random.Random(6)
    around = [(40.0 + 5 * math.sin(a), 10.0 + 5 * math.cos(a) / math.cos(math.radians(40))) for a in (2 * math.pi * i / 150 for i in range(150))]
    places = [(i, *p) for i, p in enumerate(around)]
    points = [(i, 40.0 + rng.gauss(0, 0.01), 10.0 + rng.gauss(0, 0.01)) for i in range(60)]
    got = {r.pt: r for r in nearest_place(
        spark.createDataFrame(points, "pt INT, lat DOUBLE, lon DOUBLE"), spark.createDataFrame(places, "place_id INT, lat DOUBLE, lon DOUBLE")).collect()}
    for pt, lat, lon in points:
        assert abs(got[pt].distance_km - min(km((lat, lon), p[1:]) for p in places)) <= 2e-6


def test_nearest_of_points_and_places_in_clusters(spark):
    """Points that share cubes down to the last level, places that do, and both far apart; ties go to the least id."""
    rng = random.Random(12)
    around = lambda lat, lon, r, n: [(lat + rng.uniform(-r, r), lon + rng.uniform(-r, r)) for _ in range(n)]
    spots = around(-2.2, -79.9, 1e-4, 150) + around(45.0, 179.999, 0.5, 60) + around(0, 0, 80, 60) + [(90.0, 0.0), (-90.0, 10.0), (0.0, 180.0), (0.0, -180.0)]
    sites = around(-2.2, -79.9, 1e-3, 120) + around(-2.2, -79.7, 1e-5, 80) + around(10, 10, 60, 40)
    points = [(i, a, o) for i, (a, o) in enumerate(spots)]
    places = [(1000 + i, a, o) for i, (a, o) in enumerate(sites)] + [(1, *sites[0]), (2000, *sites[0])]
    for depth in (2, 7):
        got = {r.pt: r for r in nearest_place(
            spark.createDataFrame(points, "pt INT, lat DOUBLE, lon DOUBLE"), spark.createDataFrame(places, "place_id INT, lat DOUBLE, lon DOUBLE"), depth=depth).collect()}
        for pt, lat, lon in points:
            best = min(km((lat, lon), p[1:]) for p in places)
            assert abs(got[pt].distance_km - best) <= 2e-6
            assert abs(km((lat, lon), next(p[1:] for p in places if p[0] == got[pt].place_id)) - best) <= 2e-6
        assert not {r.place_id for r in got.values()} & {1000, 2000}


def test_nearest_edge_cases(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, 0.5, 0.4)], "pt INT, lat DOUBLE, lon DOUBLE")
    places = spark.createDataFrame([(5, 0.0, 0.0), (3, 1.0, 1.0), (4, 1.0, 1.0)], "place_id INT, lat DOUBLE, lon DOUBLE")
    rows = {r.pt: r for r in nearest_place(points, places).collect()}
    assert rows[1].place_id == 5 and rows[2].place_id is None
    dropped = {r.pt: r for r in nearest_place(points, places, drop_zero_coords=True).collect()}
    assert dropped[1].place_id is None and dropped[3].place_id == 3 and rows[3].place_id == 5
    none = {r.pt: r for r in nearest_place(points, places.where("false"), fallback=(-2.175, -79.88)).collect()}
    assert (none[1].place_lat, none[1].place_lon, none[1].distance_km) == (-2.175, -79.88, None)


def test_ways(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 1.0, 1.0)], "node_id LONG, lon DOUBLE, lat DOUBLE")
    rows = spark.createDataFrame(
        [(10, [1, 2, 3, 1]), (11, [3, 99, 1]), (12, [1, 98]), (13, [2, 2, 2]), (14, [])], "way_id INT, node_ids ARRAY<LONG>"
    )
    got = {r.way_id: r for r in ways.assemble_ways(rows, nodes).collect()}
    assert set(got) == {10, 11, 13}
    assert (got[10].geometry_type, json.loads(got[10].coordinates)) == ("Polygon", [[[0, 0], [1, 0], [1, 1], [0, 0]]])
    assert (got[11].geometry_type, json.loads(got[11].coordinates)) == ("LineString", [[1, 1], [0, 0]])
    assert got[13].geometry_type == "Polygon"


def test_region_across_the_antimeridian(spark):
    df = spark.createDataFrame([(170.0, 0.0), (-170.0, 0.0), (-160.0, 1.0), (-85.0, -3.0), (0.0, 0.0)], "lon DOUBLE, lat DOUBLE")
    got = [r.r for r in df.select(geo.regions_of("lat", "lon").alias("r")).collect()]
    assert got == [["nino4"], ["nino34", "nino4"], ["nino34", "nino4"], ["nino12"], []]


def test_grid_reductions(spark):
    cells = spark.createDataFrame(
        [("2024-01-01", -1.0, -85.0, 100.0, 0.5, 0), ("2024-01-01", -1.0, -85.0, None, 0.3, 0), ("2024-01-01", -2.0, -85.0, 300.0, 0.2, 0),
         ("2024-01-02", 50.0, 0.0, 900.0, 9.0, 1)],
        "d STRING, lat DOUBLE, lon DOUBLE, sst DOUBLE, rate DOUBLE, depth INT").withColumn("date", F.to_date("d"))
    mean = grids.region_daily_mean(cells, {"sst": 100.0}).collect()
    assert [(r.region, r.mean_sst, r.n_cells) for r in mean] == [("nino12", 2.0, 3)]
    assert grids.region_daily_mean(cells, {"sst": 100.0}, end="2024-01-01").isEmpty()
    rain = grids.with_daily_rain(cells.select("date").distinct(), grids.daily_region_rain(cells, geo.OCEAN_REGIONS[0]))
    assert {r.date.day: r.rain_mm for r in rain.collect()} == {1: 0.25, 2: 0.0}
    assert grids.surface_only(cells).count() == 3


def test_collections_round_trip(spark):
    rows = spark.createDataFrame([(g, i, float(i), -float(i)) for g in "ab" for i in range(7)], "g STRING, id INT, lon DOUBLE, lat DOUBLE")
    paged = features.hashed_page(rows, ["g"], ["id"], 3)
    docs = features.feature_collections(paged, ["g"], geo.point_feature("lon", "lat", F.struct("id")), ["id"], F.col("page"))
    assert docs.agg(F.sum("n_features")).first()[0] == 14
    assert docs.where("g = 'a'").count() <= 3
    first = json.loads(docs.first().collection)
    assert first["type"] == "FeatureCollection" and first["features"][0]["geometry"]["type"] == "Point"
    back = features.explode_features(docs.withColumnRenamed("collection", "json_str"), keep=["g"])
    assert sorted((r.g, int(r.properties["id"])) for r in back.collect()) == sorted((g, i) for g in "ab" for i in range(7))


def test_explode_features_unwraps_and_skips_empty(spark):
    doc = {"metadata": {}, "data": {"type": "FeatureCollection", "features": [
        {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[[[1, 2], [3, 4]]]]}, "properties": {"a": 1}},
        {"type": "Feature", "geometry": None, "properties": None},
    ]}}
    df = spark.createDataFrame([(json.dumps(doc),), ('{"features": []}',), ("broken",)], "json_str STRING")
    rows = features.explode_features(df).collect()
    assert len(rows) == 2 and rows[0].coordinates == "[[[[1,2],[3,4]]]]" and rows[1].geometry_type is None


def test_enrich_and_lookup(spark):
    df = spark.createDataFrame([
        ("sgr_sectores_celestes", {"DISTRITO": "3"}), ("sgr_sectores_celestes", {"DISTRITO": "", "name": "n"}), ("sgr_zonas_seguras", None),
    ], "layer STRING, properties MAP<STRING, STRING>")
    got = [r.properties for r in features.enrich_features(df).collect()]
    assert got[0] == {"DISTRITO": "3", "color": "#38bdf8", "name": "Distrito 3"}
    assert got[1] == {"DISTRITO": "", "color": "#38bdf8", "name": "n"}
    assert got[2] == {}


def test_disc_is_closed_and_at_radius(spark):
    ring = spark.range(1).select(geo.geodesic_disc(F.lit(-2.19), F.lit(-79.88), 1.5, 24).alias("r")).first().r
    assert len(ring) == 25 and ring[0] == pytest.approx(ring[-1])
    assert all(km((-2.19, -79.88), (lat, lon)) == pytest.approx(1.5, abs=1e-6) for lon, lat in ring)


def test_bounds_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(1.0, 2.0)], "lat DOUBLE, lon DOUBLE").write.parquet(str(tmp_path / "p"))
    plan = ways.in_bounds(spark.read.parquet(str(tmp_path / "p")), 0.0, 0.0, 5.0, 5.0)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(lat,0.0)" in plan and "LessThanOrEqual(lat,5.0)" in plan
