"""Substring dedup: paragraphs that other documents hold too, alike or nearly so.

A paragraph is a line, and within a line a passage: lines are cut where the hash of two neighbouring words is the least
within ``REACH`` words, so a text copied into another line is cut at the same places there, but for its edges. Passages
repeat when their words are equal, lines of ``LEAST_WORDS`` words or more also when they are near: MinHash signatures of
their 5-word shingles are banded (``BANDS`` bands of ``ROWS`` values find a pair at similarity 0.8 with probability 0.993),
lines that collide in a band are joined, the exact Jaccard of their shingle sets is verified, and verified pairs are tied to
components. Pairs are verified in bands of any size (see :mod:`floodlens.llm.near_sets`).

A paragraph stays in the smallest document that holds one of its class. In the others it is marked; marked neighbours grow
together, and runs of at least ``LEAST_WORDS`` words are the result: shorter repeats are ordinary language.

Defined results: words are compared in lower case; null and empty texts have no paragraph; repeats within one document stay;
rows that repeat an id and its text are one document; a null id never counts as the smallest, so a paragraph that only rows
without id hold stays.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from floodlens.llm.common import cut, in_arrow
from floodlens.llm.encoding import chunks
from floodlens.llm.near_sets import near_components
from floodlens.llm.perfect_hash import mix

SHINGLE = 5
REACH = 4
LEAST_WORDS = 20
BANDS, ROWS = 7, 3
#: Bits of the filter that spares rows without a candidate the shuffle; a fixed size, whatever the corpus.
FILTER_BITS = 1 << 24
REMEMBERED = 800_000
_WORD = re.compile(r"\S+")
_ODD = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)

_UNITS = "hash array<long>, first array<int>, words array<int>, start array<int>, end array<int>"
_LINES = "line array<long>, line_first array<int>, line_words array<int>, line_start array<int>, line_end array<int>, bands array<long>"


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


@functools.lru_cache(maxsize=1)
def _hashes() -> _Hashes:
    return _Hashes()


def _words(text: str) -> tuple[list[str], list[int], list[int]]:
    """Words of a text in lower case, where they start, and how many each line has."""
    words, starts, lines, at = [], [], [], 0
    for line in text.split("\n"):
        own = line.split()
        if own:
            if len(line) == sum(map(len, own)) + len(own) - 1:
                place = at
                for w in own:
                    starts.append(place)
                    place += len(w) + 1
            else:
                starts.extend(at + m.start() for m in _WORD.finditer(line))
            words += own
            lines.append(len(own))
        at += len(line) + 1
    return words, starts, lines


def _sum_hash(values: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hash of each run of word hashes."""
    place = np.arange(len(values), dtype=np.uint64) - np.repeat(begins, lengths).astype(np.uint64)
    return mix(np.add.reduceat(mix(values + (place + np.uint64(1)) * _STEP), begins) + lengths.astype(np.uint64))


def _cuts(values: np.ndarray, line_of: np.ndarray) -> np.ndarray:
    """Whether a passage begins at each word: at the first of a line and where the pair hash is least around."""
    n = len(values)
    begins = np.ones(n, dtype=bool)
    begins[1:] = line_of[1:] != line_of[:-1]
    pair = np.empty(n, dtype=np.uint64)
    pair[0], pair[1:] = 0, mix(values[:-1] * np.uint64(3) + values[1:])
    least = ~begins
    for k in range(1, min(REACH, n - 1) + 1):
        same = line_of[k:] == line_of[:-k]
        before_ok = ~same | begins[:-k] | (pair[k:] < pair[:-k])
        after_ok = ~same | (pair[:-k] <= pair[k:])
        least[k:] &= before_ok
        least[:-k] &= after_ok
    return begins | least


def shingle_hashes(values: np.ndarray) -> np.ndarray:
    """Hashes of the runs of ``SHINGLE`` words, taking no notice of lines; the last few wrap and are to be left out."""
    total = np.zeros(len(values), dtype=np.uint64)
    for k in range(SHINGLE):
        total += np.roll(values, -k) * _ODD[k]
    return mix(total)


def paragraphs(texts: Sequence[str]) -> list[tuple[np.ndarray, ...]]:
    """For each text ``hash, first, words, start, end`` of its passages, then the same and the bands of its long lines."""
    hashes = _hashes()
    if len(hashes) > REMEMBERED:
        hashes.clear()
    found, ends, lines, counts = [], [], [], []
    words: list[str] = []
    for text in texts:
        own, starts, line_counts = _words(text)
        found += starts
        words += own
        lines += line_counts
        counts.append((len(own), len(line_counts)))
    per_text = np.array(counts, dtype=np.int64).reshape(-1, 2)
    if not words:
        return [tuple(np.empty(0, np.int64) for _ in range(11)) for _ in texts]
    starts = np.array(found, dtype=np.int64)
    ends = starts + np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    values = np.fromiter(map(hashes.__getitem__, map(str.lower, words)), dtype=np.uint64, count=len(words))
    lines = np.array(lines, dtype=np.int64)
    line_begin = np.cumsum(lines) - lines
    line_of = np.repeat(np.arange(len(lines)), lines)
    text_begin = np.cumsum(per_text[:, 0]) - per_text[:, 0]
    word_in_text = np.arange(len(words)) - np.repeat(text_begin, per_text[:, 0])

    begin = np.flatnonzero(_cuts(values, line_of))
    length = np.diff(np.append(begin, len(words)))
    units = [_sum_hash(values, begin, length).view(np.int64), word_in_text[begin], length, starts[begin], ends[begin + length - 1]]

    long = np.flatnonzero(lines >= LEAST_WORDS)
    b, n = line_begin[long], lines[long]
    line_key = _sum_hash(values, line_begin, lines)[long].view(np.int64)
    bands = np.empty((len(long), BANDS), dtype=np.int64)
    if len(long):
        # Shingles of long lines side by side.
        shingles = shingle_hashes(values)
        m = n - SHINGLE + 1
        offset = np.cumsum(m) - m
        picked = shingles[np.repeat(b - offset, m) + np.arange(int(m.sum()))]
        for band in range(BANDS):
            key = np.full(len(long), band, dtype=np.uint64)
            for row in range(band * ROWS, band * ROWS + ROWS):
                key = mix(key * _STEP + np.minimum.reduceat(picked * _ODD[row], offset))
            bands[:, band] = key.view(np.int64)
    long_lines = [line_key, word_in_text[b], n, starts[b], ends[b + n - 1], bands]
    unit_at = np.searchsorted(begin, np.append(text_begin, len(words)))
    line_at = np.searchsorted(b, np.append(text_begin, len(words)))
    return [tuple(x[unit_at[i]:unit_at[i + 1]] for x in units) + tuple(x[line_at[i]:line_at[i + 1]] for x in long_lines) for i in range(len(texts))]


def _lists(parts: list[np.ndarray], kind: str) -> pa.ListArray:
    flat = np.concatenate([p.reshape(-1) for p in parts]) if parts else np.empty(0)
    offsets = np.cumsum([0, *(p.size for p in parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind)))


def _cut_up(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document with its paragraphs as arrays; ``text_key`` tells texts of one id apart."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    names = [c.split()[0] for c in f"{_UNITS}, {_LINES}".split(", ")]
    kinds = ["i8", "i4", "i4", "i4", "i4"] * 2 + ["i8"]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, held in chunks(batch.column(2).to_pylist()):
                out = paragraphs(held)
                keys = [batch.column(i).slice(first, len(held)) for i in range(2)]
                yield pa.RecordBatch.from_arrays([*keys, *(_lists([o[i] for o in out], k) for i, k in enumerate(kinds))], ["doc_id", "text_key", *names])

    return in_arrow(rows, compute, f"doc_id long, text_key long, {_UNITS}, {_LINES}")


def _lines(cut_up: DataFrame) -> DataFrame:
    each = F.explode(F.arrays_zip("line", "line_first", "line_words", "line_start", "line_end"))
    return cut_up.where("size(line) > 0").select("doc_id", "text_key", each.alias("l")).select(
        "doc_id", "text_key", F.col("l.line").alias("line"), F.col("l.line_first").alias("first"), F.col("l.line_words").alias("words"),
        F.col("l.line_start").alias("start"), F.col("l.line_end").alias("end"))


def _banded(cut_up: DataFrame) -> DataFrame:
    """``node, band`` of every different line."""
    lines = cut_up.where("size(line) > 0").select("line", "bands", F.explode(F.sequence(F.lit(0), F.size("line") - 1)).alias("i"))
    lines = lines.select(F.expr("line[i]").alias("line"), *[F.expr(f"bands[i * {BANDS} + {b}]").alias(f"band{b}") for b in range(BANDS)])
    # Equal lines have equal bands; of each only one goes on.
    lines = lines.groupBy("line").agg(*[F.max(f"band{b}").alias(f"band{b}") for b in range(BANDS)])
    return lines.select(F.col("line").alias("node"), F.explode(F.array(*[f"band{b}" for b in range(BANDS)])).alias("band"))


def _likely(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows without most of those whose ``key`` is not among ``keys``; an equi-join is to follow.

    A bit per hash of a key is set, ``FILTER_BITS`` in all, in at most FILTER_BITS / 32768 rows of 4 KB, which are broadcast. A
    row is left out only if its bit is not set, so none that has a partner is lost.
    """
    at = (F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)) + 1).alias("_at")
    bits = keys.select(at).groupBy(F.expr("bitmap_bucket_number(_at)").alias("_part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(_at))").alias("_bits"))
    numbered = rows.withColumn("_at", at).withColumn("_part", F.expr("bitmap_bucket_number(_at)")).withColumn("_bit", F.expr("bitmap_bit_position(_at)"))
    byte = F.expr("cast(conv(hex(substring(_bits, cast(_bit div 8 as int) + 1, 1)), 16, 10) as int)")
    found = numbered.join(F.broadcast(bits), "_part").where(byte.bitwiseAND(F.expr("shiftleft(1, cast(_bit % 8 as int))")) != 0)
    return found.select(*rows.columns)


def _shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``line, shingles`` for lines ``wanted`` (``line, doc_id, text_key, start, end``)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = _likely(rows, wanted, "doc_id").withColumn("text_key", F.xxhash64("text"))
    text = F.expr("substring(text, start + 1, end - start)")
    places = wanted.withColumnRenamed("doc_id", "_doc").withColumnRenamed("text_key", "_key")
    lines = rows.join(places, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key"))).select("line", text.alias("text"))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _hashes()
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                words = text.lower().split()
                values = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
                out.append(np.unique(shingle_hashes(values)[:max(1, len(words) - SHINGLE + 1)].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(out, "i8")], ["line", "shingles"])

    return in_arrow(lines, compute, "line long, shingles array<long>").dropDuplicates(["line"])


def _near_lines(docs: DataFrame, cut_up: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``line, component`` of lines that are near another line."""
    def sets_of(wanted: DataFrame) -> DataFrame:
        place = F.min(F.struct("doc_id", "text_key", "start", "end")).alias("at")
        places = cut(_lines(cut_up).join(wanted.select(F.col("node").alias("line")), "line").groupBy("line").agg(place).select("line", "at.*"))
        return _shingle_sets(docs, places, id_col, text_col).withColumnRenamed("line", "node")

    return near_components(_banded(cut_up), sets_of).withColumnRenamed("node", "line")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_key, start, length, n_words, keep_id``: the runs of a document that another one holds too.

    ``start`` and ``length`` are in characters; ``keep_id`` is the smallest document where a paragraph of the run stays.
    """
    cut_up = cut(_cut_up(docs, id_col, text_col))
    units = cut_up.select("doc_id", "text_key", F.explode(F.arrays_zip("hash", "first", "words", "start", "end")).alias("p")).select("doc_id", "text_key", "p.*")
    # Only hashes and ids are grouped; a hash with two ids repeats.
    repeated = cut_up.select("doc_id", F.explode("hash").alias("hash")).groupBy("hash").agg(F.min("doc_id").alias("keep_id"), F.max("doc_id").alias("last"))
    repeated = cut(repeated.where("last > keep_id").select("hash", "keep_id"))
    other = F.col("doc_id").isNull() | (F.col("doc_id") > F.col("keep_id"))
    columns = ["doc_id", "text_key", "first", "words", "start", "end", "keep_id"]
    marked = _likely(units, repeated, "hash").join(repeated, "hash").where(other).select(columns)

    near = cut(_near_lines(docs, cut_up, id_col, text_col))
    placed = _lines(cut_up).join(near, "line")
    keep = placed.groupBy("component").agg(F.min("doc_id").alias("keep_id"))
    marked = marked.unionByName(placed.join(keep, "component").where(other).select(columns)).distinct()

    order = Window.partitionBy("doc_id", "text_key").orderBy("first", F.desc("words"))
    reached = F.max(F.col("first") + F.col("words")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = marked.withColumn("new", F.coalesce(F.col("first") > reached, F.lit(True)).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("doc_id", "text_key", "run").agg(
        F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("length"),
        (F.max(F.col("first") + F.col("words")) - F.min("first")).alias("n_words"), F.min("keep_id").alias("keep_id"))
    return spans.where(F.col("n_words") >= LEAST_WORDS).drop("run")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated runs taken out of their texts."""
    spans = repeated_spans(docs, id_col, text_col).groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("spans"))
    # A document has at most as many spans as it has paragraphs.
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"))
    found = row.join(spans, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key")), "left")
    text = F.col(f"row.{text_col}")
    kept = F.aggregate(
        "spans", F.struct(F.lit("").alias("text"), F.lit(0).alias("at")),
        lambda s, p: F.struct(F.concat(s["text"], F.substring(text, s["at"] + 1, p["start"] - s["at"])).alias("text"), (p["start"] + p["length"]).alias("at")),
        lambda s: F.concat(s["text"], F.substring(text, s["at"] + 1, F.length(text))))
    return found.withColumn("row", F.col("row").withField(text_col, F.when(F.col("spans").isNull(), text).otherwise(kept))).select("row.*")
