"""Plain double arithmetic on longitudes and latitudes, and GeoJSON pieces."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from floodlens.functions.scalars import ColumnLike, as_col

EARTH_RADIUS_KM = 6371.0


@dataclass(frozen=True)
class Box:
    """Closed longitude/latitude box of a named region."""

    region: str
    west: float
    south: float
    east: float
    north: float


# Ocean regions; the one across the antimeridian has two boxes.
OCEAN_REGIONS = (
    Box("nino12", -90.0, -10.0, -80.0, 0.0),
    Box("nino3", -150.0, -5.0, -90.0, 5.0),
    Box("nino34", -170.0, -5.0, -120.0, 5.0),
    Box("nino4", 160.0, -5.0, 180.0, 5.0),
    Box("nino4", -180.0, -5.0, -150.0, 5.0),
)


def in_box(lat: ColumnLike, lon: ColumnLike, box: Box) -> Column:
    return as_col(lat).between(box.south, box.north) & as_col(lon).between(box.west, box.east)


def regions_of(lat: ColumnLike, lon: ColumnLike, boxes: Sequence[Box] = OCEAN_REGIONS) -> Column:
    """Array of the regions holding a point; a region of several boxes appears once."""
    per_region: dict[str, Column] = {}
    for box in boxes:
        hit = in_box(lat, lon, box)
        per_region[box.region] = per_region[box.region] | hit if box.region in per_region else hit
    return F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in per_region.items()]))


def haversine_km(lat1: ColumnLike, lon1: ColumnLike, lat2: ColumnLike, lon2: ColumnLike) -> Column:
    lat1, lon1, lat2, lon2 = (F.radians(as_col(c)) for c in (lat1, lon1, lat2, lon2))
    half_lat, half_lon = F.sin((lat2 - lat1) / 2), F.sin((lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(lat1) * F.cos(lat2) * half_lon * half_lon
    a = F.least(a, F.lit(1.0))
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def unit_vector(lat: ColumnLike, lon: ColumnLike) -> tuple[Column, Column, Column]:
    """Point on the unit sphere: straight-line distance there orders like distance on the ground."""
    phi, lam = F.radians(as_col(lat)), F.radians(as_col(lon))
    return F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)


def representative_point(kind: ColumnLike, coordinates: ColumnLike) -> Column:
    """``struct(lon, lat)`` of a geometry; other kinds than the three below give NULLs."""
    kind, coords = as_col(kind), as_col(coordinates)

    def ordinate(i: int) -> Column:
        return (
            F.when(kind == "Point", F.get_json_object(coords, f"$[{i}]"))
            .when(kind == "Polygon", F.get_json_object(coords, f"$[0][0][{i}]"))
            .when(kind == "MultiPolygon", F.get_json_object(coords, f"$[0][0][0][{i}]"))
            .try_cast("double")
        )

    return F.struct(ordinate(0).alias("lon"), ordinate(1).alias("lat"))


def has_place(lat: ColumnLike, lon: ColumnLike, drop_zero_coords: bool = False) -> Column:
    """Both coordinates present. Zero is a place unless the caller asks to drop it."""
    lat, lon = as_col(lat), as_col(lon)
    ok = lat.isNotNull() & lon.isNotNull()
    return ok & (lat != 0) & (lon != 0) if drop_zero_coords else ok


def box_ring(box: Box) -> Column:
    """Closed outer ring of a box as nested arrays."""
    corners = ((box.west, box.south), (box.east, box.south), (box.east, box.north), (box.west, box.north))
    return F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in (*corners, corners[0])])


def geodesic_disc(lat: ColumnLike, lon: ColumnLike, radius_km: float = 1.5, vertices: int = 32) -> Column:
    """Closed ring of points at ``radius_km`` around a centre, as arrays of [lon, lat]."""
    phi, lam = F.radians(as_col(lat)), F.radians(as_col(lon))
    angle = radius_km / EARTH_RADIUS_KM

    def vertex(i: Column) -> Column:
        bearing = F.lit(2.0) * F.pi() * F.pmod(i, F.lit(vertices)) / F.lit(float(vertices))
        lat2 = F.asin(F.sin(phi) * F.cos(F.lit(angle)) + F.cos(phi) * F.sin(F.lit(angle)) * F.cos(bearing))
        lon2 = lam + F.atan2(
            F.sin(bearing) * F.sin(F.lit(angle)) * F.cos(phi),
            F.cos(F.lit(angle)) - F.sin(phi) * F.sin(lat2),
        )
        return F.array(F.degrees(lon2), F.degrees(lat2))

    return F.transform(F.sequence(F.lit(0), F.lit(vertices)), vertex)


def point_feature(lon: ColumnLike, lat: ColumnLike, properties: Column) -> Column:
    return F.struct(
        F.lit("Feature").alias("type"),
        F.struct(
            F.lit("Point").alias("type"), F.array(as_col(lon), as_col(lat)).alias("coordinates")
        ).alias("geometry"),
        properties.alias("properties"),
    )


def polygon_feature(ring: Column, properties: Column) -> Column:
    return F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
        properties.alias("properties"),
    )
