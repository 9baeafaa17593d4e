"""Node/way graphs into line and polygon features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodlens.functions.scalars import explode_rows, pin


def assemble_ways(
    ways: DataFrame, nodes: DataFrame, way_id: str = "way_id", node_ids: str = "node_ids", node_id: str = "node_id"
) -> DataFrame:
    """Replace node ids by coordinates in order; unknown ids vanish, and so do ways below two points.

    A way whose first point equals its last is a polygon (its ring nests once more), otherwise a
    line. The regroup is bounded by the node list of one way.
    """
    known = nodes.groupBy(F.col(node_id).alias("__node")).agg(F.max(F.struct("lon", "lat")).alias("at"))
    refs = ways.select(way_id, F.posexplode(node_ids).alias("pos", "__ref"))
    points = refs.join(known, F.col("__ref") == F.col("__node"))
    coords = F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "at"))),
        lambda p: F.array(p["at"]["lon"], p["at"]["lat"]),
    )
    shaped = points.groupBy(way_id).agg(coords.alias("coords")).where(F.size("coords") >= 2)
    closed = F.get("coords", F.lit(0)) == F.element_at("coords", -1)
    return shaped.select(
        way_id,
        F.when(closed, F.lit("Polygon")).otherwise(F.lit("LineString")).alias("geometry_type"),
        F.size("coords").alias("n_points"),
        F.when(closed, F.to_json(F.array("coords"))).otherwise(F.to_json("coords")).alias("coordinates"),
    )


def _part(element: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(element, path, kind)


def _is_whole(value: Column) -> Column:
    """Whether a variant is a whole number, written without a fraction."""
    return F.coalesce(F.schema_of_variant(value) == "BIGINT", F.lit(False))


def _is_number(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).rlike(r"\A(BIGINT|DOUBLE|FLOAT|DECIMAL.*)\z"), F.lit(False))


def _known_nodes(elements: Column) -> Column:
    """``id, at`` of the nodes that have a place, by id and place."""
    def placed(e: Column) -> Column:
        lon, lat = _part(e, "$.lon", "variant"), _part(e, "$.lat", "variant")
        return F.coalesce(_part(e, "$.type", "string") == "node", F.lit(False)) & _is_number(lon) & _is_number(lat)

    def node(e: Column) -> Column:
        at = F.array(_part(e, "$.lon", "double"), _part(e, "$.lat", "double"))
        return F.struct(_part(e, "$.id", "bigint").alias("id"), at.alias("at"))

    return F.array_sort(F.transform(F.filter(elements, placed), node))


def _ways(elements: Column) -> Column:
    """``way_id, nodes, tags`` of the ways; node ids that are no whole numbers are unknown ones."""
    def way(e: Column) -> Column:
        ids = F.coalesce(_part(e, "$.nodes", "array<variant>"), F.array().cast("array<variant>"))
        tags = F.coalesce(_part(e, "$.tags", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
        texts = F.transform_values(tags, lambda _, t: F.when(F.schema_of_variant(t) == "STRING", t.cast("string")).otherwise(F.to_json(t)))
        known = F.map_filter(texts, lambda k, t: ~F.is_variant_null(F.element_at(tags, k)))
        nodes = F.transform(ids, lambda n: F.when(_is_whole(n), F.try_variant_get(n, "$", "bigint")))
        return F.struct(_part(e, "$.id", "bigint").alias("way_id"), nodes.alias("nodes"), known.alias("properties"))

    return F.transform(F.filter(elements, lambda e: F.coalesce(_part(e, "$.type", "string") == "way", F.lit(False))), way)


def _place_of(known: Column, node: Column) -> Column:
    """The place of a node, by halving the sorted list of known ones; of nodes with one id the greatest place; NULL if unknown."""
    size = F.size(known)
    halves = F.sequence(F.ceil(F.log2(size + F.lit(1.0))).cast("int"), F.lit(0), F.lit(-1))

    def step(at: Column, bit: Column) -> Column:
        further = at + F.call_function("shiftleft", F.lit(1), bit)
        return F.when((further <= size) & (F.get(known, further - 1)["id"] <= node), further).otherwise(at)

    last = F.get(known, F.aggregate(halves, F.lit(0), step) - 1)
    return F.when(last["id"] == node, last["at"])


def document_ways(documents: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """``way_id, properties, points`` of the ways of element-list documents, with the columns ``keep``.

    A document is parsed once, as a variant; its nodes are looked up in a sorted list, so a way costs the logarithm of their
    number per node, and nothing is shuffled. Nodes without a position are unknown. A text that is no such document has no
    ways, and ways below two known points vanish.
    """
    parsed = pin(documents, keep, __elements=_part(F.try_parse_json(F.col(text)), "$.elements", "array<variant>"))
    whole = F.filter("__elements", lambda e: _is_whole(_part(e, "$.id", "variant")))
    read = pin(parsed, keep, __whole=whole)
    sorted_ = pin(read, keep, __known=_known_nodes(F.col("__whole")), __ways=_ways(F.col("__whole")))

    def shaped(way: Column) -> Column:
        points = F.filter(F.transform(way["nodes"], lambda n: _place_of(F.col("__known"), n)), lambda p: p.isNotNull())
        return F.struct(way["way_id"].alias("way_id"), way["properties"].alias("properties"), points.alias("points"))

    ways = explode_rows(sorted_, keep, F.transform("__ways", shaped))
    return ways.where(F.size("points") >= 2)


def water_tags(tags: Column) -> Column:
    """Rivers and water bodies."""
    river = F.try_element_at(tags, F.lit("waterway")) == "river"
    water = F.try_element_at(tags, F.lit("natural")) == "water"
    return F.coalesce(river, F.lit(False)) | F.coalesce(water, F.lit(False))


def in_bounds(df: DataFrame, south: float, west: float, north: float, east: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Closed bounding box; both ranges are pushed into the scan."""
    return df.where(F.col(lat).between(south, north) & F.col(lon).between(west, east))
