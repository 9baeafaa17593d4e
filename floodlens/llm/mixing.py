"""Mixing sources to target weights by systematic sampling, with DataFrame operations only.

Sources, by code point with null last, take the weights in turn. Together they are to make up the words of the whole table;
a source gets at most ``most`` times its own words, and what it cannot use is shared among the others by weight. Every
document of a source is expected ``target / source size`` times. Along the documents of a source, in order of size class,
these expectations are summed up, one offset per source is added, and a document is emitted once for every whole number
that its sum passes: so a source's words come within about one document of its target.

Sums run in levels, so that no task holds a whole source: documents per (source, size class, part), where a part holds about
``PART_ROWS`` rows of a size class that has them all (more beyond ``MOST_PARTS`` parts); parts per size class; size classes per source.

Defined results: null texts have size 0; a source without words has target 0 and takes nothing; rows that repeat are rows of
their own; an empty table gives an empty mix. The offset comes from the source's name and the seed, so reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from floodlens.llm.common import cut

WEIGHTS = (5, 2, 1)
MOST = 3
PART_ROWS = 4_000
MOST_PARTS = 100_000
SEED = "mix"


def words(text: str | Column) -> Column:
    """Number of runs of characters other than ASCII white space."""
    return F.regexp_count(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _hash32(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` from rows with ``source, size``; one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Everything below works on one row per source.
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    turn = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")).cast("long")
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    # Sources reach their cap in order of cap per weight; the first that does not sets the level of all the rest.
    all_rows = Window.partitionBy(F.lit(0))
    filling = all_rows.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    per = per.withColumn("level", level.cast("double"))
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    per = per.withColumn("first", F.max(F.when(fits, F.col("level"))).over(all_rows))  # levels fall from the first that fits on
    reached = F.coalesce(F.col("first") * F.col("weight") <= F.col("cap"), F.lit(False))
    target = F.when(reached, F.col("first") * F.col("weight")).otherwise(F.col("cap").cast("double"))
    return per.select("source", "source_size", target.alias("target"))


def _size_class() -> Column:
    """The size to its three leading bits, in order of size."""
    return F.expr("cast(length(bin(size)) * 8 + shiftright(size, greatest(length(bin(size)) - 3, 0)) as int)")


def with_copies(sized: DataFrame, rows: int, key: str, seed: str = SEED, per_source: DataFrame | None = None) -> DataFrame:
    """Add ``source_size, target, copies`` to rows with ``source, size`` and a key to order rows of one size by.

    ``rows`` is their number; it sets how many parts a size class is cut into.
    """
    parts = max(1, min(MOST_PARTS, math.ceil(rows / PART_ROWS)))
    per_source = targets(sized.select("source", "size")) if per_source is None else per_source
    name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))
    part = F.pmod(_hash32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(parts))
    rows_ = sized.withColumn("size_class", _size_class()).withColumn("part", part).withColumn("source_name", name)

    count = rows_.groupBy("source_name", "size_class", "part").agg(F.count("*").alias("n"))
    in_class = Window.partitionBy("source_name", "size_class")
    count = count.withColumn("in_class", F.sum("n").over(in_class.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    classes = count.groupBy("source_name", "size_class").agg(F.sum("n").alias("n"))
    below = Window.partitionBy("source_name").orderBy("size_class").rowsBetween(Window.unboundedPreceding, 0)
    classes = classes.withColumn("below", F.sum("n").over(below) - F.col("n")).drop("n")
    per_source = per_source.withColumn("source_name", name).drop("source")
    starts = count.join(classes, ["source_name", "size_class"]).join(per_source, "source_name").select(
        "source_name", "size_class", "part", "source_size", "target", (F.col("below") + F.col("in_class")).alias("start"))

    in_part = Window.partitionBy("source_name", "size_class", "part").orderBy("size", F.col(key).asc_nulls_last())
    rows_ = rows_.withColumn("place", F.row_number().over(in_part)).join(starts, ["source_name", "size_class", "part"])
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _hash32(F.concat(F.lit(seed + ":"), F.col("source_name"))) / F.lit(4294967296.0)
    place = F.col("start") + F.col("place")
    copies = F.floor(place * each + offset) - F.floor((place - 1) * each + offset)
    return rows_.withColumn("copies", copies.cast("long")).drop("source_name", "size_class", "part", "place", "start")


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document."""
    sized = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(text_col).alias("size")))
    mixed = with_copies(sized, sized.count(), "doc_id")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, with the columns of ``docs``."""
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(text_col).alias("size"))
    sized = cut(row.select("source", "size"))
    mixed = with_copies(row, sized.count(), "doc_id", per_source=targets(sized))
    once_each = F.expr("explode(array_repeat(0, cast(copies as int)))")
    return mixed.select("row", once_each.alias("copy")).select("row.*")


def mix_sql(weights: Sequence[int] = WEIGHTS, most: int = MOST) -> str:
    """The report in SQL."""
    weight = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    h32 = "('0x' || substr(md5({}), 1, 8))::BIGINT"
    return f"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'null' ELSE 's' || source END AS name,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), per AS (
  SELECT name, source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {weight} END AS weight
  FROM sized GROUP BY name, source
), capped AS (SELECT *, source_size * {most} AS cap FROM per
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER f, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0))::DOUBLE AS level
  FROM capped WINDOW f AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), first AS (SELECT max(level) AS level FROM levels WHERE level * weight <= cap
), target AS (
  SELECT name, source_size, CASE WHEN coalesce(f.level * weight <= cap, false) THEN f.level * weight ELSE cap::DOUBLE END AS target
  FROM capped LEFT JOIN first f ON true
), parts AS (
  SELECT *, length(bin(size)) * 8 + (size >> greatest(length(bin(size)) - 3, 0)) AS size_class,
         {h32.format("coalesce(doc_id::VARCHAR, '')")} % (SELECT least({MOST_PARTS}, greatest(1, ceil(count(*) / {PART_ROWS}.0)))::BIGINT FROM sized) AS part
  FROM sized
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY size_class, part, size, doc_id NULLS LAST) AS place FROM parts
), summed AS (
  SELECT doc_id, size, source_size, target, place, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS each,
         {h32.format(f"'{SEED}:' || name")} / 4294967296.0 AS shift
  FROM placed JOIN target USING (name)
)
SELECT doc_id, size, source_size, target, ((floor(place * each + shift::DOUBLE) - floor((place - 1) * each + shift::DOUBLE)) * size)::BIGINT AS taken
FROM summed"""
