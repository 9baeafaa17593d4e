"""Windows of bytes of many texts: how often they come, the rarest one of each needle, and where marked ones are.

A window has eight bytes at most; its key is a number made of these and their count. Keys choose pairs, which are tested after.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

from floodlens.operators.needle_trie import EDGE, bytes_ahead

_MIX = 0x9E3779B97F4A7C15
#: Windows share this many counts; a window is held at most as often as its count tells.
COUNTED_BITS = 18


def _keys(words: np.ndarray, size: int) -> np.ndarray:
    """Keys of the windows of ``size`` bytes at the head of words."""
    rest = np.uint64(8 * (EDGE - size))
    return ((words << rest) + np.uint64(size % EDGE)) * np.uint64(_MIX)


def _blocks(data: np.ndarray, offsets: np.ndarray, block: int) -> Iterator[tuple[int, np.ndarray]]:
    words, offsets = bytes_ahead(data, offsets)
    total = int(offsets[-1])
    for at in range(0, total, block):
        yield at, words[at : min(at + block, total)].copy()


def _bucket(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).view(np.int64)


def count_windows(data: np.ndarray, offsets: np.ndarray, sizes: Sequence[int], counts: np.ndarray) -> None:
    """Adds the windows of texts ``data[offsets[i]:offsets[i + 1]]`` to ``counts``, and those over two texts with them."""
    for _, words in _blocks(data, offsets, 1 << 20):
        for size in sizes:
            counts += np.bincount(_bucket(_keys(words, size), COUNTED_BITS), minlength=len(counts))


def rarest_windows(data: np.ndarray, offsets: np.ndarray, size: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each needle the window of the least count, all of a needle under ``size``: numbers of needles, keys.

    A needle with a window that no text holds occurs nowhere and is left out, and so is an empty one.
    """
    words, offsets = bytes_ahead(data, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    pos = np.arange(int(offsets[-1]))
    room, length = offsets[row + 1] - pos, np.diff(offsets)[row]
    keys = np.zeros(len(pos), np.uint64)
    for own in range(1, size + 1):
        some = np.flatnonzero(room >= size if own == size else (length == own) & (room == own))
        keys[some] = _keys(words[some], own)
    whole = np.flatnonzero((room >= size) | (room == length))
    row, keys = row[whole], keys[whole]
    held = counts[_bucket(keys, COUNTED_BITS)]
    first = np.flatnonzero(np.diff(row, prepend=-1))
    least = np.minimum.reduceat(held, first) if len(first) else held
    picked = np.flatnonzero((held == np.repeat(least, np.diff(first, append=len(row)))) & (held > 0))
    picked = picked[np.flatnonzero(np.diff(row[picked], prepend=-1))]
    return row[picked], keys[picked]


def marked_windows(data: np.ndarray, offsets: np.ndarray, sizes: Sequence[int], marks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``marks``: a bit for each head of a key, eight a byte, the lowest first. Numbers of texts and keys of windows that are marked."""
    bits = (8 * len(marks)).bit_length() - 1
    base = offsets - offsets[0]
    for at, words in _blocks(data, offsets, 1 << 17):
        rows, keys = [], []
        for size in sizes:
            own = _keys(words, size)
            bucket = _bucket(own, bits)
            pos = np.flatnonzero(marks[bucket >> 3] >> (bucket & 7).astype(np.uint8) & 1)
            row = np.searchsorted(base, pos + at, "right") - 1
            inside = base[row + 1] - pos - at >= size
            rows.append(row[inside])
            keys.append(own[pos[inside]])
        row, key = np.concatenate(rows), np.concatenate(keys)
        order = np.lexsort((key, row))
        row, key = row[order], key[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
        yield row[new], key[new]
