"""Byte-level BPE encoding and decoding through a shuffle of distinct words.

Texts are cut into words by the pattern of the rank file, and no merge crosses a word. Every task takes its documents in
chunks of bounded size; a chunk lists its distinct words, and each of its documents the places of its words in that list, in
order of position. The lists are dealt by a hash of the word into buckets, which are shuffled; there every distinct word of
the corpus is encoded once, its ids go back to the chunks that hold it, and each chunk is put together again by position. A
word travels once per chunk, not once per occurrence, however frequent it is; lists are packed, a row for each chunk and
bucket. Decoding joins ids with the table of the tokens' bytes, which is as large as the vocabulary.

Word lists and documents of a chunk are told apart in two passes over the table, so that neither is stored. A table read
from files comes in the same order again, also for a lost executor; where it does not, sums of the lists do not agree, and
the job fails rather than mix chunks up.

Defined results: null texts are empty and have no id; rows that repeat, and rows without id, are encoded like any other; ids
outside the vocabulary are an error, null lists decode to no byte.
"""

from __future__ import annotations

import base64
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodlens.llm.common import in_arrow
from floodlens.llm.encoding import BYTE_PIECES, UNUSUAL, vocabulary
from floodlens.session import ship_package

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters of a chunk, or one text, and of the text that a bucket's words come from.
CHUNK_CHARS, BUCKET_CHARS = 8_000_000, 4_000_000
#: Words or ids put together at once.
AT_ONCE = 500_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token -> rank of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def split(text: str) -> list[str]:
    """The words of a text: the matches of the public pattern, which leave nothing out."""
    if not UNUSUAL.search(text):
        return _plain()(text)
    return _splitter().split(text)


@lru_cache(maxsize=1)
def _plain():
    """The same pattern spelt out for Latin texts, which the standard library cuts faster; what is most frequent goes first.

    The contractions, which begin with a mark, only have to come before the marks.
    """
    parts = BYTE_PIECES.split("|")
    contractions = [p for p in parts if p[0] == "'"]
    letters, numbers, *rest = parts[len(contractions):]
    return re.compile("|".join([letters, numbers, *contractions, *rest])).findall


class _Splitter:
    """Cuts any text. The two libraries know different versions of Unicode: a character whose class they see differently is
    cut as one of the class that the encoding library sees."""

    #: A letter that ends no contraction, a number, and a mark.
    STAND_INS = (("Z", r"\p{L}"), ("0", r"\p{N}"), ("!", r"[^\s\p{L}\p{N}]"))

    def __init__(self) -> None:
        import public_tokenizers
        import regex
        import tiktoken

        ranks = {bytes([b]): b for b in range(256)}
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.classes = [
            (mark, regex.compile(name).match, tiktoken.Encoding("class", pat_str=name, mergeable_ranks=ranks, special_tokens={}).encode_ordinary)
            for mark, name in self.STAND_INS]
        self.known: set[str] = set()
        self.differs: dict[int, str] = {}

    def split(self, text: str) -> list[str]:
        new = set(text) - self.known
        for c in new:
            for mark, here, there in self.classes:
                if there(c) and not here(c):
                    self.differs[ord(c)] = mark
        self.known |= new
        shadow = text.translate(self.differs) if self.differs else text
        if shadow == text:
            return self.pattern.findall(text)
        return [text[m.start():m.end()] for m in self.pattern.finditer(shadow)]


@lru_cache(maxsize=1)
def _splitter() -> _Splitter:
    return _Splitter()


def pack_codes(codes: np.ndarray) -> bytes:
    """Whole numbers in groups of seven bits, the lowest first; all but the last of a number have the eighth bit set."""
    if not len(codes):
        return b""
    codes, most = codes.astype(np.int64), int(codes.max())
    lengths = np.ones(len(codes), dtype=np.int64)
    for k in range(7, most.bit_length(), 7):
        lengths += codes >= 1 << k
    start = np.cumsum(lengths) - lengths
    out = np.empty(int(start[-1] + lengths[-1]), dtype=np.uint8)
    out[start] = codes & 127
    while (more := lengths > 1).any():  # the next group of those that have one
        out[start[more]] |= 128
        codes, start, lengths = codes[more] >> 7, start[more] + 1, lengths[more] - 1
        out[start] = codes & 127
    return out.tobytes()


def unpack_codes(packed: np.ndarray) -> np.ndarray:
    """The numbers of :func:`pack_codes`, from its bytes."""
    if not len(packed):
        return np.empty(0, dtype=np.int64)
    ends = np.flatnonzero(packed < 128)
    start = np.concatenate([[0], ends[:-1] + 1])
    out = (packed[start] & 127).astype(np.int64)
    at, step = np.flatnonzero(ends > start), 7
    while len(at):
        out[at] |= (packed[start[at] + step // 7] & 127).astype(np.int64) << step
        at = at[ends[at] > start[at] + step // 7]
        step += 7
    return out


class _Codes(dict):
    """Word -> number, in order of first appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Chunk:
    """Documents taken together: their distinct words by bucket, and the places of each document's words."""

    def __init__(self) -> None:
        self.number, self.codes, self.ids, self.chars = _Codes(), [], [], 0

    def add(self, text: str, doc_id: pa.Array) -> None:
        found = split(text)
        self.codes.append(np.fromiter(map(self.number.__getitem__, found), dtype=np.int32, count=len(found)))
        self.ids.append(doc_id)
        self.chars += len(text)

    def word_rows(self, buckets: int) -> tuple[np.ndarray, list[tuple[int, bytes, bytes]]]:
        """The numbers of the words bucket by bucket, and (bucket, lengths, words) of every bucket that has any."""
        words = [w.encode() for w in self.number]
        bucket = np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words)) % buckets
        order = np.argsort(bucket, kind="stable")
        words, bucket = [words[i] for i in order.tolist()], bucket[order]
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        rows = []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(words)]):
            rows.append((int(bucket[a]), pack_codes(np.fromiter(map(len, words[a:b]), dtype=np.int64, count=b - a)), b"".join(words[a:b])))
        return order, rows

    def place_rows(self, buckets: int) -> tuple[bytes, int, list[bytes]]:
        """The place in the lists of the words by falling frequency, the sum of the lists, and the documents' words as ranks
        in that frequency, so that frequent words take one byte."""
        order, lists = self.word_rows(buckets)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        codes = np.concatenate(self.codes)
        by_rank = np.argsort(-np.bincount(codes, minlength=len(order)), kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[by_rank] = np.arange(len(order))
        packed = np.frombuffer(pack_codes(rank[codes]), dtype=np.uint8)
        # A document ends where the last byte of its last number does.
        last = np.concatenate([[0], np.flatnonzero(packed < 128) + 1])
        ends = last[np.cumsum([0, *map(len, self.codes)])].tolist()
        packed = packed.tobytes()
        total = sum(_sum(lengths, words) for _, lengths, words in lists)
        return pack_codes(place[by_rank]), total, [packed[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _sum(lengths: bytes, words: bytes) -> int:
    return zlib.crc32(words, zlib.crc32(lengths))


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, Chunk]]:
    """Numbered chunks of this task's rows (doc_id, text)."""
    from pyspark import TaskContext

    number, chunk = TaskContext.get().partitionId() << 32, Chunk()
    for batch in batches:
        for i, text in enumerate(batch.column(1)):
            chunk.add(text.as_py() or "", batch.column(0).slice(i, 1))
            if chunk.chars >= size:
                yield number, chunk
                number, chunk = number + 1, Chunk()
    if chunk.ids:
        yield number, chunk


def word_lists(docs: DataFrame, buckets: int, size: int = CHUNK_CHARS) -> DataFrame:
    """``chunk, bucket, lengths, words``: the distinct words of every chunk of ``docs`` (doc_id, text), packed by bucket."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk in _chunks(batches, size):
            _, rows = chunk.word_rows(buckets)
            if rows:
                bucket, lengths, words = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(rows), pa.int64()), pa.array(bucket, pa.int32()), pa.array(lengths, pa.binary()), pa.array(words, pa.binary())],
                    ["chunk", "bucket", "lengths", "words"])

    return in_arrow(docs, compute, "chunk long, bucket int, lengths binary, words binary")


def document_places(docs: DataFrame, buckets: int, size: int = CHUNK_CHARS) -> DataFrame:
    """``chunk, place, doc_id, codes, total``: the documents of every chunk, after a row with the places of its ranks."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk in _chunks(batches, size):
            places, total, codes = chunk.place_rows(buckets)
            n, ids = len(codes) + 1, pa.concat_arrays([pa.nulls(1, chunk.ids[0].type), *chunk.ids])
            yield pa.RecordBatch.from_arrays(
                [pa.array([number] * n, pa.int64()), pa.array(np.arange(-1, n - 1), pa.int32()), ids, pa.array([places, *codes], pa.binary()),
                 pa.array([total] + [None] * (n - 1), pa.int64())],
                ["chunk", "place", "doc_id", "codes", "total"])

    return in_arrow(docs, compute, f"chunk long, place int, doc_id {kind}, codes binary, total long")


def encode_words(lists: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``of_chunk, bucket, counts, ids, total``: the ids of every list, each distinct word of a bucket encoded once."""
    shared = lists.sparkSession.sparkContext.broadcast(ranks)  # the vocabulary
    kind = _id_kind(len(ranks))
    ship_package(lists.sparkSession)

    def compute(table: pa.Table) -> pa.Table:
        import tiktoken

        whole = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=shared.value, special_tokens={})
        known: dict[bytes, list[int]] = {}
        counts, ids, totals = [], [], []
        for packed, joined in zip(table["lengths"].to_pylist(), table["words"].to_pylist()):
            ends = np.cumsum(unpack_codes(np.frombuffer(packed, dtype=np.uint8))).tolist()
            found = []
            for a, b in zip([0, *ends[:-1]], ends):
                word = joined[a:b]
                if word not in known:
                    known[word] = whole.encode_ordinary(word.decode())
                found.append(known[word])
            counts.append(pack_codes(np.fromiter(map(len, found), dtype=np.int64, count=len(found))))
            ids.append(np.array([i for some in found for i in some], dtype=kind).tobytes())
            totals.append(_sum(packed, joined))
        columns = [table["chunk"], table["bucket"], pa.array(counts, pa.binary()), pa.array(ids, pa.binary()), pa.array(totals, pa.int64())]
        return pa.table(columns, ["of_chunk", "bucket", "counts", "ids", "total"])

    return lists.groupBy("bucket").applyInArrow(compute, "of_chunk long, bucket int, counts binary, ids binary, total long")


def _id_kind(tokens: int) -> type:
    return np.uint16 if tokens <= 1 << 16 else np.uint32


def put_together(documents: pa.Table, lists: pa.Table, kind: type) -> pa.Table:
    """The ids of a chunk's documents, from the ids of its words."""
    documents, lists = documents.sort_by("place").combine_chunks(), lists.sort_by("bucket")
    packed = documents["codes"].to_pylist()
    counts = unpack_codes(np.frombuffer(b"".join(lists["counts"].to_pylist()), dtype=np.uint8))
    flat = np.frombuffer(b"".join(lists["ids"].to_pylist()), dtype=kind).astype(np.int32)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    place = unpack_codes(np.frombuffer(packed[0], dtype=np.uint8)) if packed else np.empty(0, np.int64)
    if len(place) != len(counts) or documents["total"][0].as_py() != sum(lists["total"].to_pylist()):
        raise RuntimeError("the rows came in another order when they were read again")
    joined = np.frombuffer(b"".join(packed[1:]), dtype=np.uint8)
    at = place[unpack_codes(joined)]
    ends = np.concatenate([[0], np.cumsum(counts[at])])  # of the ids of the words so far
    words = np.concatenate([[0], np.cumsum(joined < 128)])[np.cumsum([0, *map(len, packed[1:])])]  # before each document
    ids = np.concatenate([np.empty(0, np.int32), *(_gather(flat, offsets, at[k:k + AT_ONCE]) for k in range(0, len(at), AT_ONCE))])
    lists = pa.ListArray.from_arrays(pa.array(ends[words], pa.int32()), pa.array(ids))
    return pa.table([documents["doc_id"].slice(1), lists], ["doc_id", "ids"])


def _gather(flat: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The pieces ``flat[offsets[i]:offsets[i + 1]]`` for all i of ``at``, one after another."""
    lengths = (offsets[1:] - offsets[:-1])[at]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(offsets[at] - (ends - lengths), lengths) + np.arange(total)]


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, size: int = CHUNK_CHARS, buckets: int | None = None
) -> DataFrame:
    """``doc_id, ids`` of every row, as the ``tiktoken`` library encodes its whole text. ``path``: a rank file the driver reads."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if buckets is None:
        chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
        buckets = max(1, math.ceil(chars / BUCKET_CHARS))
    ranks = read_ranks(path or vocabulary(RANKS))
    kind = _id_kind(len(ranks))
    encoded = encode_words(word_lists(rows, buckets, size), ranks)
    documents = document_places(rows, buckets, size)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>"
    return documents.groupBy("chunk").cogroup(encoded.groupBy("of_chunk")).applyInArrow(lambda a, b: put_together(a, b, kind), schema)


def token_bytes(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``id, bytes`` of every token of a rank file."""
    ranks = read_ranks(path or vocabulary(RANKS))
    return spark.createDataFrame([(rank, token) for token, rank in ranks.items()], "id int, bytes binary")


def decode(encoded: DataFrame, tokens: DataFrame, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its ids in the column ``into``. ``tokens``: id, bytes; as many rows as the vocabulary has."""
    table = tokens.orderBy("id").toPandas()
    lengths = np.zeros(int(table["id"].max()) + 1, dtype=np.int64)
    lengths[table["id"]] = table["bytes"].map(len)
    shared = encoded.sparkSession.sparkContext.broadcast((np.concatenate([[0], np.cumsum(lengths)]), b"".join(table["bytes"])))
    at = encoded.columns.index(ids_col)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets, joined = shared.value
        flat = np.frombuffer(joined, dtype=np.uint8)
        for batch in batches:
            for some in _slices(batch, at):
                lists = some.column(at)
                ids = lists.flatten().to_numpy()
                known = (ids >= 0) & (ids < len(offsets) - 1)
                if not known.all() or not np.diff(offsets)[ids].all():
                    raise ValueError("an id is not in the vocabulary")
                ends = np.concatenate([[0], np.cumsum(np.diff(offsets)[ids])])
                counts = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], dtype=np.int64)
                ends = ends[np.concatenate([[0], np.cumsum(counts)])].tolist()
                decoded = _gather(flat, offsets, ids).tobytes()
                decoded = pa.array([decoded[a:b] for a, b in zip(ends[:-1], ends[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([*some.columns, decoded], [*batch.schema.names, into])

    return in_arrow(encoded, compute, f"{_ddl(encoded)}, {into} binary")


def _slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``AT_ONCE`` ids, or one row."""
    begin, held = 0, 0
    for i, n in enumerate(batch.column(at).value_lengths().to_pylist()):
        held += n or 0
        if held >= AT_ONCE:
            yield batch.slice(begin, i + 1 - begin)
            begin, held = i + 1, 0
    if begin < len(batch):
        yield batch.slice(begin)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
