"""First mention of a long list of needles in texts: the least ranks first, the rest through an inverted index.

Only the first mention of a text is asked for, so the needles are met in the order of their ranks: a bounded head of the list is
sent to all workers, and a text that contains one of it is settled and never taken apart. What the heads leave unsettled meets the
rest of the list by an index. A text that contains a needle contains every n-gram of its bytes, so each needle is indexed under one
n-gram only, the one that texts hold least by counts of hashes, and not at all if one is in no text; n-grams of texts that no needle
has are dropped where they are read. Texts meet needles by an equality join on n-grams, and only pairs that meet are tested. The
number of pairs follows how rare the needles are, not the product of both tables.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floodlens.operators.needle_grams import COUNTED_BITS, count_windows, marked_windows, rarest_windows
from floodlens.operators.needle_trie import EDGE, NeedleTrie
from floodlens.session import ensure_checkpoint_dir, ship_package

#: Bytes of an n-gram; needles under it are indexed whole.
GRAM = EDGE
#: Bits of the filter of the index' n-grams, at least a few for each of them up to the greater number.
LEAST_MARKS, MOST_MARKS = 16, 27
#: Needles of the heads that are sent to the workers one after another, and how many bytes each has on the average at most.
HEADS, NEEDLE_BYTES = (1 << 14, 1 << 17), 32
#: A worker meets this many needles of a head first, then with the texts left as many times this more, and so on.
STEP = 1 << 8


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins and the last ends."""
    texts = texts.cast(pa.large_binary())
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8), offsets


def _head(listed: DataFrame, after: int, most: int) -> list[tuple[int, bytes]]:
    """``nid`` and bytes of the needles that come next in a sorted list: ``most`` at most, and of bounded length together."""
    due = listed.where(F.col("nid") > after)
    sizes = due.select("nid", F.octet_length("needle")).take(most)
    fit = int(np.searchsorted(np.cumsum([n for _, n in sizes]), most * NEEDLE_BYTES, "right"))
    if not fit:
        return []
    return [(nid, bytes(n)) for nid, n in due.where(F.col("nid") <= sizes[fit - 1][0]).select("nid", F.col("needle").cast("binary")).take(fit)]


def _met(rows: DataFrame, key: str, head: Sequence[tuple[int, bytes]]) -> DataFrame:
    """``key, nid, __text``: the first needle of ``head`` in each text; the text (``key, __text``) stays where there is none."""
    ship_package(rows.sparkSession)
    nids, needles = np.array([nid for nid, _ in head], np.int64), [n for _, n in head]
    tries, at = [], 0
    while at < len(needles):
        more = STEP * max(1, at)
        tries.append((at, NeedleTrie(needles[at : at + more])))
        at += more
    shared = rows.sparkSession.sparkContext.broadcast((nids, tries))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nids, tries = shared.value
        for batch in batches:
            texts = batch.column(1)
            place = np.full(len(batch), len(nids), np.int64)
            left = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False))
            for at, trie in tries:
                found = trie.first(*_bytes(texts.take(pa.array(left))))
                place[left] = np.where(found < trie.none, at + found, len(nids))
                left = left[found == trie.none]
            settled = place < len(nids)
            which = pa.array(nids[np.minimum(place, len(nids) - 1)], pa.int64(), mask=~settled)
            yield pa.RecordBatch.from_arrays([batch.column(0), which, pc.if_else(pa.array(settled), pa.scalar(None, texts.type), texts)], names=[key, "nid", "__text"])

    kind = rows.schema[key]
    schema = T.StructType([kind, T.StructField("nid", T.LongType()), T.StructField("__text", T.BinaryType())])
    met = rows.select(key, F.col("__text").cast("binary")).mapInArrow(meet, schema)
    return met.withColumn("__text", F.col("__text").cast("string"))


def _counts(rows: DataFrame, sizes: Sequence[int]) -> np.ndarray:
    """How often windows of ``sizes`` come in texts (``__text``), by hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTED_BITS, np.int64)
        for batch in batches:
            count_windows(*_bytes(batch.column(0)), sizes, counts)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], names=["at", "n"])

    found = rows.select(F.col("__text").cast("binary")).mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << COUNTED_BITS, np.int64)
    counts[found["at"].to_numpy()] = found["n"].to_numpy()
    return counts


def rarest_grams(listed: DataFrame, gram: int, counts: np.ndarray) -> DataFrame:
    """``nid, gram``: of each needle (``nid, needle``) the n-gram that texts hold least, the needle itself if it is shorter.

    A needle with an n-gram that no text holds occurs nowhere and has no row.
    """
    shared = listed.sparkSession.sparkContext.broadcast(counts)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, keys = rarest_windows(*_bytes(batch.column(1)), gram, shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(keys.view(np.int64))], names=["nid", "gram"])

    return listed.select("nid", F.col("needle").cast("binary")).mapInArrow(choose, "nid long, gram long")


def _marks(index: DataFrame) -> np.ndarray:
    """A filter of the index' n-grams: a bit for each head of one, eight a byte."""
    bits = min(MOST_MARKS, max(LEAST_MARKS, (8 * index.count()).bit_length()))
    at = F.shiftrightunsigned("gram", 64 - bits)
    parts = index.select(at.alias("at")).groupBy(F.expr("at div 32768").alias("part")).agg(F.expr("bitmap_construct_agg(at % 32768)").alias("bits"))
    marks = np.zeros((1 << bits) // 8, np.uint8)
    for part, own in parts.collect():
        marks[part * 4096 : (part + 1) * 4096] = np.frombuffer(bytes(own), np.uint8)
    return marks


def _text_grams(rows: DataFrame, key: str, sizes: Sequence[int], marks: np.ndarray) -> DataFrame:
    """``key, gram`` of texts (``key, __text``): their n-grams of ``sizes`` that are marked."""
    shared = rows.sparkSession.sparkContext.broadcast(marks)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, keys in marked_windows(*_bytes(batch.column(1)), sizes, shared.value):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(keys.view(np.int64))], names=[key, "gram"])

    return rows.select(key, F.col("__text").cast("binary")).mapInArrow(cut, T.StructType([rows.schema[key], T.StructField("gram", T.LongType())]))


def _indexed(rows: DataFrame, key: str, listed: DataFrame, gram: int) -> DataFrame:
    """``key, best`` of every text (``key, __text``) by the index of all of ``listed``."""
    ship_package(rows.sparkSession)
    gram, found = min(gram, EDGE), []
    there = rows.where(F.col("__text").isNotNull())
    sizes = sorted(r[0] for r in listed.select(F.least(F.octet_length("needle"), F.lit(gram))).distinct().collect())
    if sizes[0] == 0:
        best = listed.where("needle = ''").agg(F.min("best")).scalar()  # there is one empty needle
        found.append(there.select(key, best.alias("best")))
    if sizes := [s for s in sizes if s]:
        index = rarest_grams(listed, gram, _counts(there, sizes)).checkpoint()
        met = _text_grams(there, key, sizes, _marks(index)).join(index, "gram").select(key, "nid")
        tested = met.join(listed, "nid").join(there, key).where(F.contains("__text", F.col("needle")))
        found.append(tested.select(key, "best"))
    every = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return rows.select(key).join(every.groupBy(key).agg(F.min("best").alias("best")), key, "left")


def first_mentions(texts: DataFrame, key: str, text: str, needles: DataFrame, default: str | None = None, gram: int = GRAM) -> DataFrame:
    """``key, rank, label`` of every row of ``texts``: of the needles that its text contains the one of the least rank.

    ``needles``: ``needle, label, rank``; ties of rank go to the least label. Texts are compared as they are, so both sides
    are brought to lower case before. A text without any needle, null ones too, has no rank and the label ``default``. ``key``
    tells rows apart; rows that repeat it are one text, the greatest. An empty needle is in every text; null ones are in none.
    """
    spark = texts.sparkSession
    ensure_checkpoint_dir(spark)
    rows = texts.groupBy(key).agg(F.max(text).alias("__text")).select(key, F.when(F.col(key).isNotNull(), F.col("__text")).alias("__text"))
    listed = needles.where("needle is not null and rank is not null").groupBy("needle").agg(F.min(F.struct("rank", "label")).alias("best"))
    # The numbers follow the order of the ranks.
    listed = listed.orderBy("best", "needle").select(F.monotonically_increasing_id().alias("nid"), "needle", "best").checkpoint()
    told, last = [], -1
    for most in HEADS:
        head = _head(listed, last, most)
        if not head:
            break
        own = listed.where((F.col("nid") > last) & (F.col("nid") <= head[-1][0])).select("nid", "best")  # as many rows as the head has
        met, last = _met(rows.hint("rebalance") if told else rows, key, head).checkpoint(), head[-1][0]
        told.append(met.where("__text is null").join(F.broadcast(own), "nid", "left").select(key, "best"))
        rows = met.where("__text is not null").select(key, "__text")
        if rows.isEmpty():
            break
    rest = listed.where(F.col("nid") > last)
    if not told or not rows.isEmpty():
        told.append(_indexed(rows if told else rows.checkpoint(), key, rest, gram) if not rest.isEmpty() else rows.select(key, F.lit(None).cast(listed.schema["best"].dataType).alias("best")))
    best = told[0]
    for more in told[1:]:
        best = best.unionByName(more)
    return best.select(key, F.col("best.rank").alias("rank"), F.coalesce("best.label", F.lit(default)).alias("label")).hint("rebalance")
