"""Sketches of texts: MinHash values of their shingles of five words, in bands that near copies share.

Two texts at a Jaccard similarity of 0.8 have half of the ``BANDS`` bands of ``ROWS`` values in common, at least one with
probability 0.99999.

Defined results: words are what white space separates, in lower case; a text under five words is one shingle; texts without a
word are alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from floodlens.llm.common import in_arrow
from floodlens.llm.perfect_hash import mix

SHINGLE = 5
BANDS, ROWS = 16, 3
_ODD = mix(np.arange(101, 101 + BANDS * ROWS, dtype=np.uint64)) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, part: int = 0) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order; those of different parts have none in common."""
    import xxhash

    words = (text or "").lower().split()
    width = min(SHINGLE, len(words))
    known = {w: xxhash.xxh3_64_intdigest(w) for w in set(words)}
    values = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(words) - width + 1 if words else 1
    total = np.full(n, part * SHINGLE + width, dtype=np.uint64)
    for k in range(width):
        total += values[k:k + n] * _ODD[k]
    return np.unique(mix(total))


def sketch(own: np.ndarray) -> tuple[int, np.ndarray]:
    """A key that equal sets share, and the bands."""
    key = mix(np.array([mix(own).sum(dtype=np.uint64)]))
    bands = np.arange(BANDS, dtype=np.uint64)
    least = np.array([(own * odd).min() for odd in _ODD], dtype=np.uint64).reshape(ROWS, BANDS)
    for values in least:
        bands = mix(bands * _STEP + values)
    return int(key.view(np.int64)[0]), bands.view(np.int64)


def sketches(rows: DataFrame) -> DataFrame:
    """``id, text_key, part, node, bands`` of rows ``id, text_key, part, text``."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [sketch(shingles(t.as_py(), p.as_py())) for t, p in zip(batch.column(3), batch.column(2))]
            added = [pa.array([k for k, _ in out], pa.int64()), pa.array([b for _, b in out], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *added], ["id", "text_key", "part", "node", "bands"])

    return in_arrow(rows, compute, "id long, text_key long, part int, node long, bands array<long>")
