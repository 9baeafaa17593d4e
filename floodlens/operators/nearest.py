"""Exact nearest place by great-circle distance without comparing all pairs.

Points and places are each put into a hierarchy of cubes around the unit sphere (a level splits an edge by four); a cube keeps
the tight box around what it holds, a cube of places also one place as its representative. Both hierarchies are walked
together: a cube of points meets a cube of places. The farthest corner of the points' box from a representative bounds how far
the nearest place of any of its points can be, and place cubes whose box is farther than the least such bound fall away.
Then the point cubes split, take over what is left, and the place cubes split. So points that lie together share a walk down to
the cube where they part, a cube with one point is that point, a cube with one place is not split any more, and the walk ends
where both hierarchies do: on spread data a few levels, on dense clusters up to ``depth``. A cube of the last level is searched
whole. Where very many places are almost equally near (a circle around a point) they all stay until the end, and the work
grows with their number. Straight-line distance on the sphere orders places exactly like ground distance; the final choice is
made by the haversine distance itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodlens.functions.geometry import has_place, haversine_km, unit_vector
from floodlens.session import ensure_checkpoint_dir

DEPTH = 7  # cube edge of about 780 metres
MAX_DEPTH = 10  # cube edge of about twelve metres; three 21-bit indices still fit one long
_SLACK = 1e-9  # straight-line slack that covers the rounding of distances to micro-kilometres


def _edge(level: int) -> float:
    return 2.0 / 4**level


def _place_on_sphere(lat: str, lon: str) -> list[Column]:
    """Unit vector and its cube indices on the deepest level; coarser cubes are shifts of those."""
    vector = unit_vector(lat, lon)
    finest = F.lit(_edge(MAX_DEPTH))
    steps = [F.least(F.floor((v + F.lit(1.0)) / finest), F.lit(4**MAX_DEPTH - 1)).cast("long") for v in vector]
    return [c.alias(n) for n, c in zip(("x", "y", "z", "ix", "iy", "iz"), (*vector, *steps))]


def _cube(level: int | str) -> Column:
    """Cube holding the row's position on a level: three 21-bit indices in one long."""
    shift = f"2 * ({MAX_DEPTH} - {level})"
    ix, iy, iz = (f"shiftright({i}, {shift})" for i in ("ix", "iy", "iz"))
    return F.expr(f"shiftleft({ix}, 42) | shiftleft({iy}, 21) | {iz}")


def _parent(cube: Column) -> Column:
    mask = F.lit(((1 << 21) - 1) >> 2)
    ix, iy, iz = F.shiftright(cube, 44), F.shiftright(cube, 23).bitwiseAND(mask), F.shiftright(cube, 2).bitwiseAND(mask)
    return F.shiftleft(ix, 42).bitwiseOR(F.shiftleft(iy, 21)).bitwiseOR(iz)


_AXES = ("x", "y", "z")
#: Columns of a cube of points, of a cube of places, and of its representative.
_POINTS = ("acube", *(f"a{end}{c}" for c in _AXES for end in ("lo", "hi")))
_PLACES = ("cube", "n", *(f"b{end}{c}" for c in _AXES for end in ("lo", "hi")), "pid", "plat", "plon", "rx", "ry", "rz")


def _gap2() -> Column:
    """Square of the least straight-line distance between the box of the points and the box of the places."""
    total = F.lit(0.0)
    for c in _AXES:
        gap = F.greatest(F.lit(0.0), F.col(f"blo{c}") - F.col(f"ahi{c}"), F.col(f"alo{c}") - F.col(f"bhi{c}"))
        total = total + gap * gap
    return total


def _far2() -> Column:
    """Square of the greatest straight-line distance from the box of the points to the representative."""
    total = F.lit(0.0)
    for c in _AXES:
        far = F.greatest(F.abs(F.col(f"ahi{c}") - F.col(f"r{c}")), F.abs(F.col(f"r{c}") - F.col(f"alo{c}")))
        total = total + far * far
    return total


def _reach2(bound: Column) -> Column:
    reach = F.sqrt(bound) + F.lit(_SLACK)
    return reach * reach


def _within(square: Column) -> Column:
    """Not farther than the bound. No not-null filters are inferred from a coalesced condition;
    pushed down, they would recompute the walk."""
    return F.coalesce(square <= _reach2(F.col("bound")), F.lit(False))


def _on_levels(df: DataFrame, depth: int, columns: Sequence[str]) -> DataFrame:
    """One row per level down to ``depth`` with the cube holding the row's position."""
    levels = df.select(*columns, "ix", "iy", "iz", F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("level"))
    return levels.select(*columns, "level", _cube("level").alias("cube"))


def _boxes(prefix: str) -> list[Column]:
    return [f(c).alias(f"{prefix}{end}{c}") for c in _AXES for end, f in (("lo", F.min), ("hi", F.max))]


def _place_cubes(places: DataFrame, depth: int) -> DataFrame:
    """Non-empty cubes of all levels: number and box of their places, and the greatest place id's place."""
    which = [F.max_by(c, "pid").alias(n) for c, n in (("plat", "plat"), ("plon", "plon"), ("x", "rx"), ("y", "ry"), ("z", "rz"))]
    grouped = _on_levels(places, depth, ["pid", "plat", "plon", *_AXES]).groupBy("level", "cube")
    return grouped.agg(F.count(F.lit(1)).alias("n"), *_boxes("b"), F.max("pid").alias("pid"), *which)


def _point_cubes(spots: DataFrame, depth: int) -> DataFrame:
    grouped = _on_levels(spots, depth, list(_AXES)).groupBy("level", F.col("cube").alias("acube"))
    return grouped.agg(F.count(F.lit(1)).alias("an"), *_boxes("a"))


def _tightened(pairs: DataFrame) -> DataFrame:
    """Pairs that may hold a nearest place, with the least bound that their point cube has met."""
    per_cube = Window.partitionBy("acube")
    near = pairs.where(_within(_gap2())).withColumn("bound", F.least("bound", F.min(_far2()).over(per_cube)))
    return near.where(_within(_gap2())).select(*_POINTS, *_PLACES, "bound")


def _split_points(walk: DataFrame, cubes: DataFrame) -> DataFrame:
    """The walk of every point cube of a level handed on to its cubes of the next one."""
    below = cubes.select(_parent(F.col("acube")).alias("aparent"), *[F.col(c).alias(f"new_{c}") for c in _POINTS])
    opened = walk.join(below, F.col("acube") == F.col("aparent"))
    return opened.select(*[F.col(f"new_{c}").alias(c) for c in _POINTS], *_PLACES, "bound").where(_within(_gap2()))


def _split_places(walk: DataFrame, cubes: DataFrame) -> DataFrame:
    """Place cubes of a level opened, but for those with one place."""
    below = cubes.select(_parent(F.col("cube")).alias("parent"), *[F.col(c).alias(f"new_{c}") for c in _PLACES])
    opened = walk.join(below, (F.col("cube") == F.col("parent")) & (F.col("n") > 1), "left")
    return opened.select(*_POINTS, *[F.coalesce(f"new_{c}", c).alias(c) for c in _PLACES], "bound")


def nearest_place(
    points: DataFrame,
    places: DataFrame,
    place_id: str = "place_id",
    lat: str = "lat",
    lon: str = "lon",
    keep: Sequence[str] = (),
    fallback: tuple[float, float] | None = None,
    drop_zero_coords: bool = False,
    depth: int = DEPTH,
    digits: int = 6,
) -> DataFrame:
    """Add ``place_id``, ``place_lat``, ``place_lon`` and ``distance_km`` of the nearest place.

    Equal rounded distances go to the least place id. Points without a place (no coordinates, or no
    places at all) keep NULLs, or get ``fallback`` as their destination. ``drop_zero_coords`` holds
    for points and places: a zero coordinate is no place.
    """
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be from 1 to {MAX_DEPTH}")
    spark = points.sparkSession
    ensure_checkpoint_dir(spark)
    # Copies of a place collapse to the least id; the index is reused by every level below.
    index = (
        places.where(has_place(lat, lon, drop_zero_coords))
        .groupBy(F.col(lat).alias("plat"), F.col(lon).alias("plon"))
        .agg(F.min(place_id).alias("pid"))
        .select("pid", "plat", "plon", *_place_on_sphere("plat", "plon"))
        .checkpoint()
    )
    # The answer depends on the coordinates alone: copies of a point are looked up once.
    spots = (
        points.where(has_place(lat, lon, drop_zero_coords)).select(F.col(lat).alias("slat"), F.col(lon).alias("slon")).distinct()
        .select("slat", "slon", *_place_on_sphere("slat", "slon"))
        .checkpoint()
    )
    cubes, point_cubes = _place_cubes(index, depth).checkpoint(), _point_cubes(spots, depth).checkpoint()
    # Below the level where every cube holds one place, and every cube one point, there is nothing to split.
    ends = [df.where(F.col(n) > 1).agg(F.max("level")).first()[0] or 0 for df, n in ((cubes, "n"), (point_cubes, "an"))]
    last = min(depth, max(ends) + 1)

    # Level one has at most 64 cubes: they travel as one array value. 4 is the square of the diameter.
    top = cubes.where("level = 1").agg(F.collect_list(F.struct(*_PLACES))).scalar()
    first = point_cubes.where("level = 1").withColumn("__top", top).withColumn("bound", F.lit(4.0))
    walk = _tightened(first.select(*_POINTS, "bound", F.explode_outer("__top").alias("c")).select(*_POINTS, "bound", "c.*"))
    for level in range(2, last + 1):
        walk = _split_points(walk, point_cubes.where(F.col("level") == level))
        walk = _tightened(_split_places(walk, cubes.where(F.col("level") == level)))

    # The points themselves, against the places left: a cube's only one, or all that a cube of the last level holds.
    own = spots.select("slat", "slon", _cube(last).alias("own"), *[F.col(c).alias(f"s{c}") for c in _AXES])
    met = walk.join(own, F.col("acube") == F.col("own")).withColumns({f"a{end}{c}": F.col(f"s{c}") for c in _AXES for end in ("lo", "hi")})
    met = met.where(_within(_gap2()))
    here = index.select(_cube(last).alias("leaf"), *[F.col(c).alias(f"new_{n}") for c, n in (("pid", "pid"), ("plat", "plat"), ("plon", "plon"), ("x", "rx"), ("y", "ry"), ("z", "rz"))])
    found = met.join(here, (F.col("cube") == F.col("leaf")) & (F.col("n") > 1), "left")
    found = found.select("slat", "slon", *[F.col(f"a{end}{c}") for c in _AXES for end in ("lo", "hi")], "bound",
                         *[F.coalesce(f"new_{c}", c).alias(c) for c in ("pid", "plat", "plon", "rx", "ry", "rz")])
    nearest = (
        found.where(_within(_far2()))
        .withColumn("d", F.round(haversine_km("slat", "slon", "plat", "plon"), digits))
        .groupBy("slat", "slon")
        .agg(F.min(F.struct("d", "pid", "plat", "plon")).alias("best"))
        .select(
            "slat", "slon",
            F.col("best.pid").alias(place_id), F.col("best.plat").alias("place_lat"),
            F.col("best.plon").alias("place_lon"), F.col("best.d").alias("distance_km"),
        )
    )
    answered = points.join(nearest, (F.col(lat) == F.col("slat")) & (F.col(lon) == F.col("slon")), "left")
    if fallback is not None:
        answered = answered.withColumns({
            "place_lat": F.coalesce("place_lat", F.lit(float(fallback[0]))),
            "place_lon": F.coalesce("place_lon", F.lit(float(fallback[1]))),
        })
    return answered.select(*(keep or points.columns), place_id, "place_lat", "place_lon", "distance_km")
