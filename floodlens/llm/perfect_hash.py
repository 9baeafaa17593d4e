"""Minimal perfect hash of 64-bit keys by hash and displace, in numpy."""

from __future__ import annotations

import numpy as np

KEYS_PER_BUCKET = 3
_TRIES = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (fixed values: multipliers of the splitmix64 generator)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash(keys: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    return mix(keys + np.asarray(seed, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    """32 bits of a key that its slot does not depend on."""
    return (_hash(keys.astype(np.int64).view(np.uint64), 1) >> np.uint64(32)).astype(np.uint32)


def build(keys: np.ndarray) -> np.ndarray:
    """Displacements that :func:`slots` needs; ``keys`` are distinct.

    Buckets are placed from the fullest down, each by the first displacement that leads its keys to free slots. Buckets of one
    key take the slots left over and name theirs, written as a negative number.
    """
    keys = keys.astype(np.int64).view(np.uint64)
    n = len(keys)
    buckets = max(1, -(-n // KEYS_PER_BUCKET))
    moves = np.zeros(buckets, dtype=np.int64)
    if not n:
        return moves
    bucket = (_hash(keys, 0) % np.uint64(buckets)).astype(np.int64)
    keys = keys[order := np.argsort(bucket, kind="stable")]
    sizes = np.bincount(bucket, minlength=buckets)
    first = np.cumsum(sizes) - sizes
    taken = np.zeros(n, dtype=bool)
    for b in np.argsort(-sizes, kind="stable"):
        size = int(sizes[b])
        if size < 2:
            break
        own, tried = keys[first[b]:first[b] + size], 0
        while True:
            seeds = np.arange(2 + tried, 2 + tried + _TRIES, dtype=np.uint64)
            slots_ = (_hash(own[None, :], seeds[:, None]) % np.uint64(n)).astype(np.int64)
            ordered = np.sort(slots_, axis=1)
            good = ~taken[slots_].any(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if good.any():
                at = int(np.argmax(good))
                moves[b] = tried + at
                taken[slots_[at]] = True
                break
            tried += _TRIES
    single = np.flatnonzero(sizes == 1)
    moves[single] = -1 - np.flatnonzero(~taken)[:len(single)]
    return moves


def slots(keys: np.ndarray, moves: np.ndarray, n: int) -> np.ndarray:
    """The slot of each key, from 0 to n - 1: its own if the key was built in, any other if not."""
    keys = keys.astype(np.int64).view(np.uint64)
    if not n:
        return np.zeros(len(keys), dtype=np.int64)
    move = moves[(_hash(keys, 0) % np.uint64(len(moves))).astype(np.int64)]
    hashed = (_hash(keys, (np.maximum(move, 0) + 2).astype(np.uint64)) % np.uint64(n)).astype(np.int64)
    return np.where(move < 0, -1 - move, hashed)
