"""Best-fit packing planned on the histogram of lengths.

Documents become token ids with an end id; those longer than a sequence are cut into pieces. Only the counts of each length
(at most one per token of a sequence) come to the driver. Best-fit decreasing runs over these counts: bins with the same room
left are handled as one range, so the plan has a few rows per length whatever the number of documents. A piece takes the slot
that belongs to its rank within its length. Ranks are counted in parts, so that no task holds a whole length.

Defined results: null and empty texts are one end id; rows that repeat are packed one by one; an empty table packs into
nothing; sequence numbers run from 0 without gaps.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from floodlens.llm import encoding
from floodlens.llm.common import cut, in_arrow

TOKENIZER = "word_bpe_49k.json"
SEQUENCE = 2048
END = 0
PART_ROWS = 1_000
MOST_PARTS = 100_000

_SLOT = np.dtype([("length", "i8"), ("first", "i8"), ("each", "i8"), ("sequence", "i8"), ("offset", "i8")])


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, size: int = SEQUENCE,
           path: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding.encoder(tokenizer, path)
        end = np.array([END], dtype="<u4")
        for batch in batches:
            ids_of, texts = batch.column(0), batch.column(1).to_pylist()
            for first, held in encoding.chunks(texts):
                ids, counts = encoder.encode(held)
                out, at = [], 0
                for i, n in enumerate(counts.tolist()):
                    document = np.concatenate([ids[at:at + n].astype("<u4"), end])
                    at += n
                    for k, start in enumerate(range(0, n + 1, size)):
                        part = document[start:start + size]
                        out.append((first + i, k, start, len(part), zlib.crc32(part.tobytes())))
                row, *columns = (np.array(c, dtype=np.int64) for c in zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [ids_of.take(pa.array(row)), pa.array(columns[0].astype(np.int32)), *map(pa.array, columns[1:])],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    return in_arrow(rows, compute, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan_slots(counts: Mapping[int, int], size: int = SEQUENCE) -> np.ndarray:
    """Slots for ``counts`` pieces of each length, by (length, first rank).

    A row gives the ranks from ``first`` to the next row's: every sequence from ``sequence`` on takes ``each`` of them, the
    first at ``offset``.
    """
    ranges: dict[int, list[tuple[int, int]]] = {}  # room left -> (first sequence, number of sequences)
    rooms: list[int] = []
    opened, slots = 0, []

    def leave(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in ranges:
                ranges[room] = []
                bisect.insort(rooms, room)
            ranges[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = ranges[room].pop()
                if not ranges[room]:
                    del ranges[room], rooms[at]
            else:
                room, first, n = size, opened, -(-left // (size // length))
                opened += n
            each = room // length
            full = min(n, left // each)
            if full:
                slots.append((length, rank, each, first, size - room))
                leave(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n:
                if left:  # fewer than one sequence takes
                    slots.append((length, rank, left, first + full, size - room))
                    leave(room - left * length, first + full, 1)
                    rank, left, full = rank + left, 0, full + 1
                leave(room, first + full, n - full)
    return np.array(sorted(slots), dtype=_SLOT)


def ranked(rows: DataFrame, counts: Mapping[int, int]) -> DataFrame:
    """Add ``rank``, from 0 within ``length``, to pieces whose lengths have these counts."""
    part_rows = max(PART_ROWS, sum(counts.values()) // MOST_PARTS)
    parts = rows.sparkSession.createDataFrame([(int(k), -(-n // part_rows)) for k, n in counts.items()], "length long, parts long")
    # One row per length of at most SEQUENCE tokens.
    rows = rows.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("parts"))).drop("parts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    starts = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    starts = starts.select("length", "part", (F.sum("n").over(before) - F.col("n")).alias("before"))
    in_part = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    rows = rows.withColumn("in_part", F.row_number().over(in_part) - 1).join(starts, ["length", "part"])
    return rows.withColumn("rank", F.col("before") + F.col("in_part")).drop("part", "before", "in_part")


def pack_pieces(rows: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """Add ``sequence_id, offset`` to pieces; ``rows`` is read several times, so it should be a table."""
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    plan = plan_slots(counts, size)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    starts = plan["length"] << 40 | plan["first"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(n).to_numpy() for n in ("length", "rank"))
            slot = plan[np.searchsorted(starts, length << 40 | rank, side="right") - 1] if len(batch) else plan[:0]
            rank = rank - slot["first"]
            sequence = slot["sequence"] + rank // slot["each"]
            offset = slot["offset"] + rank % slot["each"] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return in_arrow(ranked(rows, counts).select(*names, "rank"), place, schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, size: int = SEQUENCE) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of every document."""
    return pack_pieces(cut(pieces(docs, id_col, text_col, tokenizer, size)), size)
