"""SimHash near-dedup through deletion-variant signatures.

A fingerprint has 64 bits; documents link when theirs differ in at most two. Cut into two segments of 32 bits, one segment
then differs in at most one. So every distinct fingerprint is indexed under 64 keys, its segments with one bit left out;
fingerprints that meet under a key are joined and verified. A key shared by more than ``CROWD`` fingerprints would give too
many pairs: its members are instead indexed under their whole value and its 64 one-bit neighbours. Two values at most two
bits apart have such a point in common, any two that share one are at most two bits apart, and at most 65 share it, so
tying all to the smallest is exact and stays linear.

Defined results: no word gives fingerprint zero, which links like any other; null texts are empty; rows that repeat are rows
of their own; a null id never names a component unless all its members lack an id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodlens.llm.common import cut, in_arrow
from floodlens.llm.components import connected_components

SHINGLE = 3
SEED = 42
BITS = 2
CROWD = 32
_BLOCK = 1 << 16
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles, unsigned: a bit is set when over half of the hashes have it."""
    import xxhash

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    width = min(width, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - width + 1
    begins, ends = begins[:n].tolist(), ends[width - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _BLOCK):
        pairs = zip(begins[at:at + _BLOCK], ends[at:at + _BLOCK])
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), dtype="<u8", count=min(_BLOCK, n - at))
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """``doc_id, text_key, fp`` of every row: a hash of its text and the fingerprint, as signed numbers."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_py(), width) for t in batch.column(2)]
            prints = pa.array(np.array(values, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), prints], ["doc_id", "text_key", "fp"])

    return in_arrow(rows, compute, "doc_id long, text_key long, fp long")


def links(prints: DataFrame, bits: int = BITS, crowd: int = CROWD) -> DataFrame:
    """Pairs ``u, v`` of distinct fingerprints whose closure is that of all pairs at most two bits apart."""
    if bits != BITS:
        raise ValueError("two segments with one bit left out find pairs up to two bits apart")
    keyed = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k"))
    segment = "shiftright(fp, 32 * (k div 32)) & 4294967295L"
    key = f"shiftleft(cast(k as long), 32) | (({segment}) & ~shiftleft(1L, k % 32))"
    keyed = keyed.select(F.expr(key).alias("key"), "fp")
    # Counted by an aggregate and joined back: no task holds a crowded key.
    crowds = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(keyed.join(crowds, "key"))

    few = shared.where(F.col("n") <= crowd)
    pairs = few.select("key", F.col("fp").alias("u")).join(few.select("key", F.col("fp").alias("v")), "key")
    pairs = pairs.where(f"u > v and bit_count(u ^ v) <= {bits}").select("u", "v").distinct()

    many = shared.where(F.col("n") > crowd).select("fp").distinct()
    ball = many.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("k"))
    ball = ball.select("fp", F.expr("case when k = 64 then fp else fp ^ shiftleft(1L, k) end").alias("point"))
    # A point has at most 65 members, so its set is small whatever the crowd.
    stars = ball.groupBy("point").agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1")
    stars = stars.select(F.array_min("fps").alias("v"), F.explode("fps").alias("u")).where("u > v").select("u", "v").distinct()
    return pairs.unionByName(stars)


def classes(prints: DataFrame) -> DataFrame:
    """``fp, class`` (the least fingerprint reachable) of the distinct fingerprints of ``prints``."""
    distinct = cut(prints.select("fp").distinct())
    groups = connected_components(links(distinct)).select(F.col("node").alias("fp"), "component")
    return distinct.join(groups, "fp", "left").select("fp", F.coalesce("component", "fp").alias("class"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` (the smallest id reachable) of every row."""
    prints = cut(fingerprints(docs, id_col, text_col).select("doc_id", "fp"))
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first")).join(classes(prints), "fp")
    least = first.groupBy("class").agg(F.min("first").alias("component_id"))
    named = cut(first.join(least, "class").select("fp", "component_id"))
    found = prints.join(named, "fp", "left")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with the columns of ``docs``: the first by id and hash of its text, a null id coming last.

    Rows that repeat id and text are one document. What is dropped is joined by id and text, so copies of a text are dealt
    apart, and of rows that repeat both a task passes on one.
    """
    key = ["none", "doc_id", "text_key"]
    prints = cut(fingerprints(docs, id_col, text_col).select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "text_key", "fp"))
    rows = prints.groupBy(*key).agg(F.min("fp").alias("fp"), F.count("*").alias("n"))
    rows = cut(rows.join(classes(prints), "fp").select(*key, "n", "class"))
    first = rows.groupBy("class").agg(F.min(F.struct(*key)).alias("first"))
    placed = rows.join(first, "class").withColumn("stays", F.struct(*key) == F.col("first"))
    elsewhere = placed.where("not stays or n > 1").select(*key)
    again = placed.where("stays and n > 1").select(*key)
    text = F.coalesce(F.col(text_col), F.lit(""))
    id_ = F.col(id_col).cast("long")
    whole = docs.select(F.struct(*docs.columns).alias("row"), id_.isNull().alias("none"), F.coalesce(id_, F.lit(0)).alias("doc_id"), F.xxhash64(text).alias("text_key"))
    alone = whole.join(elsewhere, key, "left_anti").select("row")
    return alone.unionByName(whole.join(again, key).groupBy(*key).agg(F.any_value("row").alias("row")).select("row")).select("row.*")
