"""Connected components of a graph whose edges are a table, by alternating large and small stars.

A large star ties all larger neighbours of a node to its smallest neighbour, a small star all smaller ones. Both keep the
components; after some rounds every node hangs on the smallest of its component. No neighbourhood is gathered: a star is one
minimum per node and a join, whose heavy side may be split. A round writes as few parts as its edges fill.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodlens.llm.common import cut

#: Edges of a part that a round writes, at least.
PART_EDGES = 50_000


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _smallest(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = _smallest(edges)
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) for every node of ``edges``, rows of two ids ``u, v``.

    Edges with a null end and loops link nothing; a node that has only such edges has no row.
    """
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(edges)
    while mark[0]:
        edges = edges.coalesce(max(1, math.ceil(mark[0] / PART_EDGES)))
        edges = cut(_small_star(_large_star(edges)))
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.withColumn("component", F.col("node")))
