"""Periodic runs of words, found by block convolution.

A run is a longest stretch of consecutive words whose smallest period q leaves it at least ``max(LEAST, TIMES * q)`` words.
Blocks of L = 2, 4, 8, ... words stand at the multiples of L. A run with (2L - 1) / 3 <= q < (4L - 1) / 3 holds one of them
together with its next occurrence q words further on. So every block is compared with all places of that range at once: the
sum of squared differences between block and window is

    sum(block^2) + sum(window^2) - 2 * sum(block * window),

and the last sum, for all distances, is one product of number-theoretic transforms modulo 65537. Words stand there as whole
numbers so small that no sum of L products reaches the modulus: the sums are exact, and where one is zero no symbol differs.
Such a distance seeds an extension to both sides, by binary search over prefix hashes of the words themselves; a stretch that
is long enough is compared word by word before it counts. Stretches whose distance is a multiple of their smallest period are
the runs of that period once more and go.

Blocks beyond ``LONGEST`` words are represented by their first ``LONGEST`` ones, and their range is searched in pieces, so a
transform is of bounded size for texts of any length. Transforms are products with matrices of at most 256 columns, exact in
doubles. Texts of a batch are searched together, apart by a word that occurs once.

Defined results: words are runs of characters other than ASCII white space; null texts have no word; rows that repeat, and
rows without id, are searched like any other. A word goes from the collapsed text if a run holds it after its first period.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodlens.llm.common import in_arrow
from floodlens.llm.encoding import chunks

#: A run has at least so many words, and so many periods.
LEAST, TIMES = 6, 4
#: Longest block that is transformed, and numbers handled at once.
LONGEST, AT_ONCE = 4_096, 1 << 15
#: Modulus and one of its primitive roots.
PRIME, ROOT = 65_537, 3

RUN = "struct<start:bigint,length:bigint,period:bigint>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _reduced(x: np.ndarray) -> np.ndarray:
    """Congruent whole numbers between -PRIME and 2 * PRIME."""
    parts = x * (1 / PRIME)
    np.floor(parts, out=parts)
    parts *= PRIME
    return np.subtract(x, parts, out=parts)


@lru_cache(maxsize=64)
def _powers(rows: int, columns: int, order: int, sign: int) -> np.ndarray:
    """w ** (sign * row * column) for a root w of that order."""
    root = pow(ROOT, (PRIME - 1) // order, PRIME)
    power = np.array([pow(root, k, PRIME) for k in range(order)], dtype=np.float64)
    return power[sign * np.outer(np.arange(rows), np.arange(columns)) % order]


def _shape(size: int) -> tuple[int, int]:
    """The factors of a transform; small ones take a single product."""
    first = 1 if size <= 128 else 1 << (size.bit_length() - 1) // 2
    return first, size // first


def transform(x: np.ndarray, sign: int) -> np.ndarray:
    """Transforms of the rows of ``x``, as (row, k1, k2) for the frequency k1 + n1 * k2."""
    size = x.shape[1]
    n1, n2 = _shape(size)
    if n1 == 1:
        return _reduced(x @ _powers(n2, n2, n2, sign)).reshape(-1, 1, n2)
    x = _reduced(_powers(n1, n1, n1, sign) @ x.reshape(-1, n1, n2))
    return _reduced(_reduced(x * _powers(n1, n2, size, sign)) @ _powers(n2, n2, n2, sign))


def back(z: np.ndarray) -> np.ndarray:
    """The rows whose transforms with sign 1 are ``z``, as numbers from 0 to PRIME - 1."""
    _, n1, n2 = z.shape
    z = _reduced(z @ _powers(n2, n2, n2, -1))
    if n1 > 1:
        z = _reduced(_powers(n1, n1, n1, -1) @ _reduced(z * _powers(n1, n2, n1 * n2, -1)))
    z = _reduced(z.reshape(-1, n1 * n2) * pow(n1 * n2, -1, PRIME))
    return z + PRIME * (z < 0) - PRIME * (z >= PRIME)


def mismatches(blocks: np.ndarray, windows: np.ndarray, offsets: int) -> np.ndarray:
    """Sums of squared differences of each block with its window, for the first ``offsets`` places of the block in it.

    Windows are twice as long as blocks. Symbols are whole numbers of at most :func:`largest` of the block's length.
    """
    length = blocks.shape[1]
    padded = np.zeros_like(windows)
    padded[:, :length] = blocks
    both = back(_reduced(transform(padded, -1) * transform(windows, 1)))[:, :offsets]
    squares = np.cumsum(np.pad(windows**2, ((0, 0), (1, 0))), axis=1)
    return (blocks**2).sum(axis=1, keepdims=True) + squares[:, length:length + offsets] - squares[:, :offsets] - 2 * both


def largest(length: int) -> int:
    """The greatest symbol with which ``length`` products stay below the modulus."""
    return int(((PRIME - 1) // length) ** 0.5)


def _mixed(ids: np.ndarray) -> np.ndarray:
    """64 bits that stand for each word."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _longest(ok, limit: np.ndarray) -> np.ndarray:
    """The greatest length up to ``limit`` for which ``ok`` holds, which holds for all shorter ones."""
    low, high = np.zeros_like(limit), limit.copy()
    while (low < high).any():
        middle = (low + high + 1) // 2
        good = ok(middle)
        low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
    return low


class _Stretches:
    """Longest stretches of a period around given places."""

    def __init__(self, ids: np.ndarray, mixed: np.ndarray) -> None:
        self.ids = ids
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(ids), 0xD6E8FEB86659FD93, dtype=np.uint64)]), dtype=np.uint64)
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed * self.power[:-1], dtype=np.uint64)])

    def around(self, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the stretch in which words a period apart are equal, by hash, from ``at`` on and before it."""
        sums, power = self.sums, self.power

        def equal(i: np.ndarray, length: np.ndarray) -> np.ndarray:
            with np.errstate(over="ignore"):
                return (sums[i + length] - sums[i]) * power[period] == sums[i + period + length] - sums[i + period]

        after = _longest(lambda n: equal(at, n), len(self.ids) - at - period)
        before = _longest(lambda n: equal(at - n, n), at)
        return at - before, at + after + period

    def plainly(self, at: int, period: int) -> tuple[int, int]:
        """The same, word by word."""
        ids, i, j = self.ids, at, at
        while i > 0 and ids[i - 1] == ids[i - 1 + period]:
            i -= 1
        while j + period < len(ids) and ids[j] == ids[j + period]:
            j += 1
        return i, j + period

    def true(self, start: int, end: int, period: int) -> bool:
        return bool((self.ids[start:end - period] == self.ids[start + period:end]).all())


def _hits(symbols: np.ndarray, starts: np.ndarray, length: int, low: int, offsets: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks (their first place) and distances, from ``low`` on, without a mismatch."""
    wide = np.lib.stride_tricks.sliding_window_view(symbols, 2 * length)
    rows = max(1, AT_ONCE // (2 * length))
    found = []
    for k in range(0, len(starts), rows):
        some = starts[k:k + rows]
        windows = wide[some + low].astype(np.float64)
        row, offset = np.nonzero(mismatches(wide[some, :length].astype(np.float64), windows, offsets) == 0)
        found.append((some[row], offset + low))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2


def find_runs(ids: np.ndarray, bounds: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, end, period) of all runs, by start and period.

    ``ids`` are the words of texts one after another, text k from ``bounds[k]`` to before ``bounds[k + 1] - 1``, where a word
    stands that occurs nowhere else. ``times`` is 4 or more: with less a run need not hold the block that finds it.
    """
    if times < TIMES:
        raise ValueError("blocks find runs of four periods or more")
    runs = np.empty((0, 3), dtype=np.int64)
    if not len(ids):
        return runs
    mixed = _mixed(ids)
    stretches = _Stretches(ids, mixed)
    sizes = np.diff(bounds) - 1
    covering = np.full(len(ids), -1, dtype=np.int64)
    length = 2
    while True:
        low, high = -(-(2 * length - 1) // 3), -(-(4 * length - 1) // 3)  # periods from low to before high
        if max(sizes) < max(least, times * low):
            break
        starts = np.arange(0, len(ids), length)
        text = np.searchsorted(bounds, starts, side="right") - 1
        starts = starts[(sizes[text] >= max(least, times * low)) & (starts + length + low <= bounds[text + 1] - 1)]
        taken = min(length, LONGEST)
        symbols = np.concatenate([mixed % np.uint64(largest(taken) + 1), np.zeros(high + 2 * taken, dtype=np.uint64)]).astype(np.int32)
        pieces = [_hits(symbols, starts, taken, at, min(taken, high - at)) for at in range(low, high, taken)]
        block, period = (np.concatenate(x) for x in zip(*pieces))
        inside = block + period + taken <= len(ids)
        block, period = block[inside], period[inside]
        for last in (0, 1):  # what lies in a run already found, at a distance that its period divides, is that run again
            if len(runs) and len(block):
                over = covering[block + last * (period + taken - 1)]
                known = (over >= 0) & (runs[over, 0] <= block) & (block + period + taken <= runs[over, 1]) & (period % runs[over, 2] == 0)
                block, period = block[~known], period[~known]
        if len(block):
            runs = _added(runs, covering, stretches, block, period, least, times)
        length *= 2
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _added(runs: np.ndarray, covering: np.ndarray, stretches: _Stretches, block: np.ndarray, period: np.ndarray, least: int, times: int) -> np.ndarray:
    """``runs`` and those around blocks that recur at a distance."""
    start, end = stretches.around(block, period)
    long = end - start >= np.maximum(least, times * period)
    seeds = np.stack([start, end, period], axis=1)[long]
    new, group = np.unique(seeds, axis=0, return_inverse=True)
    checked = []
    for k, (s, e, q) in enumerate(new.tolist()):
        if stretches.true(s, e, q):
            checked.append((s, e, q))
            continue
        # Different words had equal hashes: each of the places decides for itself, word by word.
        plain = {stretches.plainly(i, q) for i in block[long][group.reshape(-1) == k].tolist()}
        checked += [(s, e, q) for s, e in plain if e - s >= max(least, times * q)]
    known = {(s, e) for s, e, _ in runs.tolist()}
    fresh = []
    for s, e, q in sorted(set(checked), key=lambda r: r[2]):
        if (s, e) not in known:  # the same stretch with a smaller period
            known.add((s, e))
            fresh.append((s, e, q))
            covering[s:e] = len(runs) + len(fresh) - 1
    return np.concatenate([runs, np.array(fresh, dtype=np.int64).reshape(-1, 3)])


def runs_of_texts(texts: Sequence[str]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """The words of each text and its runs (start, end, period), counted from the text's first word."""
    words = [t.encode().split() for t in texts]
    number: dict[bytes, int] = {}
    flat: list[int] = []
    for some in words:
        flat.extend([number.setdefault(w, len(number)) for w in some])
        flat.append(-1)
    ids = np.array(flat, dtype=np.int64)
    apart = np.flatnonzero(ids < 0)
    ids[apart] = len(number) + np.arange(len(apart))
    bounds = np.concatenate([[0], apart + 1])
    found = find_runs(ids, bounds)
    part = np.searchsorted(found[:, 0], bounds)
    for k, some in enumerate(words):
        yield some, found[part[k]:part[k + 1]] - [bounds[k], bounds[k], 0]


def collapse(words: Sequence[bytes], runs: np.ndarray) -> bytes:
    """The words without those that repeat the first period of a run."""
    if len(runs):
        stays = np.ones(len(words), dtype=bool)
        for start, end, period in runs.tolist():
            stays[start + period:end] = False
        words = [words[i] for i in np.flatnonzero(stays).tolist()]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row: its runs by start and period, and its text without their repeats."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(_values(batch.column(1))):
                counts, collapsed, runs = [], [], [np.empty((0, 3), dtype=np.int64)]
                for words, found in runs_of_texts(texts):
                    counts.append(len(words))
                    collapsed.append(collapse(words, found))
                    runs.append(found)
                ends = np.cumsum([0] + [len(r) for r in runs[1:]]).astype(np.int32)
                start, end, period = np.concatenate(runs).T
                each = pa.StructArray.from_arrays([pa.array(start), pa.array(end - start), pa.array(period)], fields=list(_RUN))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), each),
                     pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return in_arrow(rows, compute, f"doc_id {kind}, n_words long, runs array<{RUN}>, collapsed string")


def _values(column: pa.Array) -> Iterator[str | None]:
    """The values of a column one by one, so that no more than a chunk of them is held."""
    return (x.as_py() for x in column)
