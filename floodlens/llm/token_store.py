"""Token ids on disk: raw payload files with a minimal perfect hash index for keyed access.

Documents are range-partitioned by key and the beginning of their text, and sorted by key and text, so rows without key, or of one
key, may fill many shards. Each partition writes one shard:

* ``NAME.ids``: the ids of its documents one after another, little-endian unsigned, nothing else; 16 bits each if the
  vocabulary has at most 65,536 entries, else 32;
* ``NAME.idx``: eight little-endian signed 64-bit numbers (magic, version, rows, rows without key, distinct keys, buckets,
  bytes of an id, one spare), then ``starts`` (rows + 1, int64, in ids), ``keys`` (rows, int64, ascending), ``moves`` (buckets, int64), and
  by slot ``fingerprint``, ``row`` and ``rows`` (uint32, int64, int64).

A key leads through ``moves`` to its slot in constant time; the fingerprint there tells a key that the shard lacks (but for
one in 2**32), the row there its place in ``starts``. Files of a failed attempt have names of their own and are never listed:
a shard exists once the checkpointed manifest names it.

Defined results: null texts are empty, so a document is at least its end id; rows that repeat a key lie side by side, ordered
by text, within a shard and from shard to shard, and each shard's index gives its first and their number; rows without key come
first and can be read but not looked up; an empty table gives no shard.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from floodlens.llm import encoding, perfect_hash
from floodlens.llm.common import cut, in_arrow
from floodlens.session import shared_dir

TOKENIZER = "byte_bpe_50k.json"
END = 0
MAGIC, VERSION = 0x58444953444B4F54, 1
_HEADER = 8
#: Characters of a text by which rows of one key, or of none, are dealt to shards.
PREFIX = 24
#: Ids read from a payload file at once.
READ_IDS = 1 << 20


class ShardIndex:
    """The index of one shard, in memory."""

    def __init__(self, keys: np.ndarray, without_key: int, lengths: np.ndarray, width: int) -> None:
        self.keys, self.without_key, self.width = keys.astype("<i8"), without_key, width
        self.starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<i8")
        distinct, first, rows = np.unique(keys[without_key:], return_index=True, return_counts=True)
        self.moves = perfect_hash.build(distinct).astype("<i8")
        slot = perfect_hash.slots(distinct, self.moves, len(distinct))
        self.fingerprint, self.row, self.rows = (np.zeros(len(distinct), dtype=t) for t in ("<u4", "<i8", "<i8"))
        self.fingerprint[slot], self.row[slot], self.rows[slot] = perfect_hash.fingerprints(distinct), first + without_key, rows

    def to_bytes(self) -> bytes:
        header = np.array([MAGIC, VERSION, len(self.keys), self.without_key, len(self.row), len(self.moves), self.width, 0], dtype="<i8")
        return b"".join(x.tobytes() for x in (header, self.starts, self.keys, self.moves, self.fingerprint, self.row, self.rows))

    @classmethod
    def from_bytes(cls, data: bytes) -> ShardIndex:
        header = np.frombuffer(data, "<i8", _HEADER)
        if header[0] != MAGIC or header[1] != VERSION:
            raise ValueError("not an index of this format")
        index, at = cls.__new__(cls), header.nbytes
        rows, index.without_key, distinct, buckets, index.width = map(int, header[2:7])
        for name, kind, n in (("starts", "<i8", rows + 1), ("keys", "<i8", rows), ("moves", "<i8", buckets),
                              ("fingerprint", "<u4", distinct), ("row", "<i8", distinct), ("rows", "<i8", distinct)):
            setattr(index, name, np.frombuffer(data, kind, n, at))
            at += getattr(index, name).nbytes
        return index

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows of each key; no rows where the shard lacks the key."""
        if not len(self.row):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        slot = perfect_hash.slots(keys, self.moves, len(self.row))
        return self.row[slot], np.where(self.fingerprint[slot] == perfect_hash.fingerprints(keys), self.rows[slot], 0)


def _open(base: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(base)


def write(docs: DataFrame, base: str | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """Write a store below ``base`` (a fresh shared folder by default); returns its manifest.

    The manifest has one row per shard: ``base, name, part, rows, ids, first_key, last_key, start`` (ids of all shards before).
    """
    base = base or shared_dir(docs.sparkSession, "token-store")
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Equal beginnings stay together; the sort goes on by the whole text.
    rows = rows.repartitionByRange("key", F.substring("text", 1, PREFIX)).sortWithinPartitions("key", "text")

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding.encoder(tokenizer)
        width = 2 if encoder.library.get_vocab_size() <= 1 << 16 else 4
        part = TaskContext.get().partitionId()
        name, out, keys, lengths, without = f"{part:06d}-{uuid.uuid4().hex[:12]}", None, [], [], 0
        for batch in batches:
            if not len(batch):
                continue
            if out is None:
                system, folder = _open(base)
                system.create_dir(folder, recursive=True)
                out = system.open_output_stream(f"{folder}/{name}.ids")
            without += batch.column(0).null_count
            keys.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False))
            for _, held in encoding.chunks(batch.column(1).to_pylist()):
                ids, counts = encoder.encode(held)
                ends = np.cumsum(counts)
                out.write(np.insert(ids.astype(f"<u{width}"), ends, END).tobytes())
                lengths.append(counts + 1)
        if out is not None:
            out.close()
            index = ShardIndex(np.concatenate(keys), without, np.concatenate(lengths), width)
            with system.open_output_stream(f"{folder}/{name}.idx") as file:
                file.write(index.to_bytes())
            bounds = index.keys[[without, -1]] if without < len(index.keys) else [None, None]
            yield pa.RecordBatch.from_pydict({"name": [name], "part": pa.array([part], pa.int32()), "rows": [len(index.keys)], "ids": [int(index.starts[-1])],
                                              "first_key": pa.array([bounds[0]], pa.int64()), "last_key": pa.array([bounds[1]], pa.int64())})

    schema = "name string, part int, rows long, ids long, first_key long, last_key long"
    shards = cut(in_arrow(rows, shard, schema))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)  # one row per shard
    return shards.select(F.lit(base).alias("base"), *shards.columns, (F.sum("ids").over(before) - F.col("ids")).alias("start"))


def _ids(file, width: int, first: int, last: int) -> np.ndarray:
    """Ids from one place of a payload up to another, as 32-bit numbers."""
    file.seek(width * first)
    return np.frombuffer(file.read(width * (last - first)), f"<u{width}").astype("<u4")


def _crcs(file, width: int, starts: np.ndarray, lengths: np.ndarray) -> Iterator[int]:
    """Checksum of the ids, as 32-bit numbers, of rows that lie one after another; read in blocks."""
    at = 0
    while at < len(starts):
        last = max(at + 1, int(np.searchsorted(starts + lengths, starts[at] + READ_IDS, side="right")))
        data = memoryview(_ids(file, width, int(starts[at]), int(starts[last - 1] + lengths[last - 1])).tobytes())
        for s, n in zip((4 * (starts[at:last] - starts[at])).tolist(), (4 * lengths[at:last]).tolist()):
            yield zlib.crc32(data[s:s + n])
        at = last


def read_back(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every stored document, each found through its shard's index."""
    shards = manifest.select("base", "name", "start").repartition(max(1, manifest.count()), "name")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                system, folder = _open(shard["base"])
                with system.open_input_stream(f"{folder}/{shard['name']}.idx") as file:
                    index = ShardIndex.from_bytes(file.read())
                keyed = index.keys[index.without_key:]
                distinct, place = np.unique(keyed, return_index=True)
                first, rows = index.find(distinct)
                if rows.sum() != len(keyed):
                    raise ValueError(f"shard {shard['name']}: its index does not find its keys")
                repeat = np.arange(len(keyed)) - np.repeat(place, rows)
                row = np.concatenate([np.arange(index.without_key), np.repeat(first, rows) + repeat])
                start = index.starts[row]
                length = index.starts[row + 1] - start
                with system.open_input_file(f"{folder}/{shard['name']}.ids") as file:
                    crc = np.fromiter(_crcs(file, index.width, start, length), dtype=np.int64, count=len(row))
                keys = pa.array(index.keys, mask=np.arange(len(row)) < index.without_key)
                yield pa.RecordBatch.from_arrays([keys, pa.array(start + shard["start"]), pa.array(length), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return in_arrow(shards, scan, "doc_id long, start long, n_tokens long, ids_crc32 long")


def look_up(manifest: DataFrame, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """``key, ids`` (array) for every stored document of the keys asked for; a key that is not stored has no row.

    Shards follow one another, so the bounds in the manifest (one row per shard, held by the driver) lead a key to the one that
    holds it, or to all of a key that fills several.
    """
    shards = manifest.where("last_key is not null").orderBy("part").select("base", "name", "first_key", "last_key").collect()
    first_keys, last_keys = (np.array([s[c] for s in shards], dtype=np.int64) for c in ("first_key", "last_key"))
    wanted = keys.select(F.col(key_col).cast("long").alias("key")).where("key is not null").distinct()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            begin, end = np.searchsorted(last_keys, keys), np.searchsorted(first_keys, keys, side="right")
            n = np.maximum(end - begin, 0)
            each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(begin, n) + each), pa.array(np.repeat(keys, n))], ["shard", "key"])

    held = in_arrow(wanted, route, "shard long, key long").repartition("shard").sortWithinPartitions("shard", "key")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            out: list[tuple[int, np.ndarray]] = []
            for want in batch.to_pylist():
                if want["shard"] != at:
                    at = want["shard"]
                    system, folder = _open(shards[at]["base"])
                    with system.open_input_stream(f"{folder}/{shards[at]['name']}.idx") as file:
                        index = ShardIndex.from_bytes(file.read())
                    payload = system.open_input_file(f"{folder}/{shards[at]['name']}.ids")
                first, rows = index.find(np.array([want["key"]]))
                for row in range(int(first[0]), int(first[0] + rows[0])):
                    ids = _ids(payload, index.width, int(index.starts[row]), int(index.starts[row + 1]))
                    out.append((want["key"], ids.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([v for _, v in out], pa.list_(pa.int64()))], ["key", "ids"])

    return in_arrow(held, fetch, "key long, ids array<long>")
