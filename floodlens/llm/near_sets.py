"""Components of sets whose Jaccard similarity is at least 0.8, by MinHash bands and exact verification.

Sets that collide in a band are candidates. In bands of up to ``CROWD`` members every pair is one; in a fuller band every
member is first compared with ``CENTRES`` members drawn by hash, others in each band, which ties most of a large group
without a quadratic number of pairs. Pairs of a crowd that are not tied then are looked for exactly: in one order of the
shingles for all, rare ones first, two sets at 0.8 or more have one of their ``size div 5 + 1`` first shingles in common, and
the places of the first common one bound how much can follow, the more frequent it is the less. So the members of crowds
that are more than one component are joined on these shingles and the classes of size that their places leave possible, the
largest component of a shingle only with the others. So every pair that shares a band is verified or already tied, whatever
the band's size. Only the first shingles become rows; the order comes from counts of their hashes, a table of a fixed size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from floodlens.llm.common import cut, cut_table, in_arrow
from floodlens.llm.components import connected_components

CROWD, CENTRES = 64, 16
#: Members of a part of a crowd.
PART = 4_096
#: Members of a shingle and class that are paired in one block, and words of 64 bits that hold the parities of a set.
BLOCK, PARITIES = 512, 8
#: Hashes under which the holders of shingles are counted, whatever their number, and parts in which the counts are summed.
COUNTED, COUNT_PARTS = 1 << 20, 256
#: Sets that a worker puts in order together.
SORTED = 1_024
#: Sizes of one class differ by less than this factor.
CLASS = 1.02
#: The least similarity as a fraction, so that bounds are whole numbers.
_PARTS, _OF = 4, 5


def _placed(banded: DataFrame) -> DataFrame:
    """``node, band, n, h``: the members of bands that have more than one, with their number and an order of their own.

    The order differs from band to band, and so do the centres of a crowd that meets in all of them.
    """
    counts = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    return banded.join(counts, "band").select("node", "band", "n", F.xxhash64("band", "node").alias("h"))


def _centres(placed: DataFrame, crowd: int) -> DataFrame:
    """``band, v, centre``: all members of small bands, the first few in the order of a crowd, each with its place in that order.

    A crowd is cut into parts by its order's hash, and only the first of every part are looked at together.
    """
    first = F.struct("h", "node")
    small = placed.where(F.col("n") <= crowd).select("band", "node", first.alias("centre"))
    parts = F.pmod(F.xxhash64("h"), F.ceil(F.col("n") / PART))
    in_part = Window.partitionBy("band", "part").orderBy("h", "node")
    crowds = placed.where(F.col("n") > crowd).withColumn("part", parts).withColumn("k", F.row_number().over(in_part)).where(F.col("k") <= CENTRES)
    in_band = Window.partitionBy("band").orderBy("h", "node")
    crowds = crowds.withColumn("k", F.row_number().over(in_band)).where(F.col("k") <= CENTRES).select("band", "node", first.alias("centre"))
    return small.unionByName(crowds).select("band", F.col("node").alias("v"), "centre")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    u, v = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "uv")
    both = F.size(F.array_intersect("set_u", "set_v"))
    return pairs.join(u, "u").join(v, "v").where(both * _OF >= _PARTS * (F.size("set_u") + F.size("set_v") - both)).select("u", "v")


def _hashed(shingles: np.ndarray) -> np.ndarray:
    return (shingles.view(np.uint64) % np.uint64(COUNTED)).astype(np.int64)


def _flat(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False)


def _holders(sets: DataFrame) -> np.ndarray:
    """How many sets hold a shingle of each hash; every partition sends the hashes it has met once, with their counts."""
    of_part = COUNTED // COUNT_PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTED, dtype=np.int64)
        for batch in batches:
            for first in range(0, batch.num_rows, SORTED):
                at, times = np.unique(_hashed(_flat(batch.column(0).slice(first, SORTED))), return_counts=True)
                total[at] += times
        met = np.flatnonzero(total)
        for at in np.split(met, np.searchsorted(met, np.arange(1, COUNT_PARTS) * of_part)):
            if len(at):
                values = [at[0] // of_part], [(at % of_part).astype("<i4").tobytes()], [total[at].astype("<i8").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.binary(), pa.binary()))], ["part", "at", "times"])

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(of_part, dtype=np.int64)
        for at, times in zip(rows["at"].to_pylist(), rows["times"].to_pylist()):
            total[np.frombuffer(at, "<i4")] += np.frombuffer(times, "<i8")
        total = np.minimum(total, np.iinfo(np.int32).max).astype("<i4")
        return pa.table({"part": rows["part"].slice(0, 1), "total": pa.array([total.tobytes()], pa.binary())})

    found = np.zeros(COUNTED, dtype=np.int32)
    met = in_arrow(sets.select("shingles"), count, "part int, at binary, times binary")
    for row in met.groupBy("part").applyInArrow(add, "part int, total binary").collect():
        found[row["part"] * of_part:(row["part"] + 1) * of_part] = np.frombuffer(row["total"], "<i4")
    return found


def _ordered(members: DataFrame) -> DataFrame:
    """``node, component, size, first, odd`` of ``node, component, shingles``: the first shingles of a set, rare ones first, and its parities.

    Bit k of the parities tells whether the number of shingles that hash to k is odd; sets differ in as many shingles at least as in bits.
    """
    shared = members.sparkSession.sparkContext.broadcast(_holders(members))  # a number for each of COUNTED hashes

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, SORTED):
                rows = batch.slice(begin, SORTED)
                size = rows.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                flat, row = _flat(rows.column(2)), np.repeat(np.arange(len(size)), size)
                order = np.lexsort((flat, shared.value[_hashed(flat)], row))
                length = np.minimum(size - (size * _PARTS + _OF - 1) // _OF + 1, size)
                first = flat[order][np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) < np.repeat(length, size)]
                bits = np.bincount(row * 64 * PARITIES + flat % (64 * PARITIES), minlength=len(size) * 64 * PARITIES).astype(np.uint8) & 1
                odd = np.packbits(bits, bitorder="little").view("<i8")
                lists = [(first, np.append(0, np.cumsum(length))), (odd, np.arange(len(size) + 1) * PARITIES)]
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64())) for values, ends in lists]
                yield pa.RecordBatch.from_arrays([*rows.columns[:2], pa.array(size, pa.int32()), *lists], ["node", "component", "size", "first", "odd"])

    return in_arrow(members.select("node", "component", "shingles"), compute, "node long, component long, size int, first array<long>, odd array<long>")


def _classes(least: str, most: str) -> Column:
    """The classes of the sizes from ``least`` to ``most``."""
    return F.sequence(*[F.expr(f"cast(floor(ln({size}) / ln({CLASS})) as int)") for size in (least, most)])


def _untied(placed: DataFrame, sets: DataFrame, tied: DataFrame, crowd: int) -> DataFrame:
    """Pairs ``u, v`` of members of crowded bands that are in different components and may be near by their first shingles."""
    crowded = placed.where(F.col("n") > crowd).select("node", "band").join(tied, "node", "left").withColumn("component", F.coalesce("component", "node"))
    crowded = cut_table(crowded)
    open_ = crowded.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band")
    members = crowded.join(open_, "band").select("node", "component").distinct()
    ordered = cut_table(_ordered(cut_table(members.join(sets, "node"))))
    first = ordered.select("node", "component", "size", F.posexplode("first").alias("place", "shingle"))
    # Two sets have no more in common than follows their first common shingle, so one that has it at this place is near to none that is larger than this.
    first = first.withColumn("most", F.expr(f"({_OF} * size - {_PARTS + _OF} * place) div {_PARTS}").cast("int")).drop("place")
    short = F.col("most") >= F.col("size")
    held = first.groupBy("shingle", "component").agg(
        F.count("*").alias("members"), F.min(F.when(short, F.col("size"))).alias("low"), F.max(F.when(short, F.col("size"))).alias("high"),
        F.max(F.when(short, F.col("most"))).alias("reach"))
    held = held.groupBy("shingle").agg(
        F.max(F.struct("members", "component"))["component"].alias("largest"), F.count("*").alias("components"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.max("reach").alias("reach")).where("components > 1 and low is not null")
    keyed = first.join(held.drop("components"), "shingle").join(ordered.select("node", "odd"), "node")
    keyed = cut_table(keyed.withColumn("in_largest", F.expr("component = largest")).drop("largest"))

    # The larger set of a pair is u. Pairs within the largest component of a shingle are not looked at.
    key = ["shingle", "class_u", "class_v", "largest_v"]
    own, columns = _classes("size", "size")[0], ["node", "component", "size", "most", "odd"]
    u = keyed.withColumn("least", F.expr(f"greatest(low, ceil(size * {_PARTS} / {_OF}))")).withColumn("greatest", F.expr("least(high, size, most)"))
    u = u.where("least <= greatest and size <= reach").withColumn("largest_v", F.explode(F.expr("if(in_largest, array(false), array(false, true))")))
    u = u.withColumn("class_u", own).withColumn("class_v", F.explode(_classes("least", "greatest")))
    v = keyed.where(short).withColumnRenamed("in_largest", "largest_v").withColumn("class_v", own)
    v = v.withColumn("class_u", F.explode(_classes("size", "most")))
    u, v = (rows.select(*key, *[F.col(c).alias(f"{c}_{name}") for c in columns]) for rows, name in ((u, "u"), (v, "v")))
    # The smaller sets of a key in blocks, so that no task has a frequent shingle alone.
    blocks = v.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    u = u.join(blocks, key).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).drop("blocks")
    v = v.join(blocks, key).withColumn("block", F.expr("cast(pmod(xxhash64(node_v), blocks) as int)")).drop("blocks")
    differ = " + ".join(f"bit_count(odd_u[{k}] ^ odd_v[{k}])" for k in range(PARITIES))
    both = u.join(v, [*key, "block"]).where("component_u <> component_v and size_v <= most_u and size_u <= most_v")
    both = both.where("size_v < size_u or size_v = size_u and node_v < node_u")
    both = both.where(f"({differ}) * {_PARTS + _OF} <= (size_u + size_v) * {_OF - _PARTS}")
    return both.select(F.col("node_u").alias("u"), F.col("node_v").alias("v")).distinct()


def near_components(banded: DataFrame, sets_of: Callable[[DataFrame], DataFrame], crowd: int = CROWD) -> DataFrame:
    """``node, component`` of the sets that are near another one.

    ``banded`` has ``node, band`` for each distinct set and band; ``sets_of`` gives ``node, shingles`` for a table of ``node``.
    """
    placed = cut_table(_placed(banded))
    pairs = placed.join(_centres(placed, crowd), "band").where(F.struct("h", "node") > F.col("centre"))
    pairs = cut_table(pairs.select(F.col("node").alias("u"), "v").distinct())
    sets = cut(sets_of(placed.select("node").distinct()))
    tied = cut(connected_components(_verified(pairs, sets)))
    if placed.where(F.col("n") > crowd).isEmpty():
        return tied
    more = cut(_verified(_untied(placed, sets, tied, crowd), sets))
    if more.isEmpty():
        return tied
    return connected_components(tied.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))
