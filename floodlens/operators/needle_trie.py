"""A bounded list of needles as a trie of eight bytes an edge, met by many texts at once.

Texts and needles are UTF-8, where a needle found among the bytes is found among the characters. A position of a text is
followed while what stands there is an edge; hashes only choose where to look, edges are compared whole.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

EDGE = 8
_MIX, _NODE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Positions looked at together, so that what is made of them stays in a core's cache.
_BLOCK = 1 << 15


def bytes_ahead(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts ``data[offsets[i]:offsets[i + 1]]`` the eight bytes from each position on, as numbers, and offsets among these."""
    start, total = int(offsets[0]), int(offsets[-1] - offsets[0])
    padded = np.zeros(total + EDGE, np.uint8)
    padded[:total] = data[start : start + total]
    return np.ndarray(total + 1, "<u8", padded, strides=(1,)), offsets - start


class NeedleTrie:
    """``first`` tells of each text the place in ``needles`` of the first needle that it contains, or their number."""

    def __init__(self, needles: Sequence[bytes]) -> None:
        self.none = len(needles)
        self.empty = next((i for i, n in enumerate(needles) if not n), self.none)
        edges: dict[tuple[int, int, int], list[int]] = {}  # node, bytes and what they are: first needle that ends there, next node
        nodes = 1
        for place, needle in enumerate(needles):
            node = 0
            for at in range(0, len(needle), EDGE):
                piece = needle[at : at + EDGE]
                edge = edges.setdefault((node, len(piece), int.from_bytes(piece, "little")), [self.none, 0])
                if at + EDGE >= len(needle):
                    edge[0] = min(edge[0], place)
                elif not edge[1]:
                    edge[1], nodes = nodes, nodes + 1
                node = edge[1]
        self.tables, self.filters = {}, {}
        for size in sorted({s for _, s, _ in edges}):
            own = np.array([(node, word) for node, s, word in edges if s == size], np.uint64)
            goal = np.array([edge for (_, s, _), edge in edges.items() if s == size], np.int64)
            mix = _MIX
            while len(np.unique(key := self._keys(own[:, 0], own[:, 1], mix))) < len(key):
                mix += 2
            order = np.argsort(key)
            self.tables[size] = (mix, key[order], own[order, 0], own[order, 1], goal[order, 0], goal[order, 1])
            if len(root := own[own[:, 0] == 0, 1]):
                bits = min(20, max(10, (16 * len(root)).bit_length()))
                marks, shift = np.zeros(1 << bits, bool), np.uint64(64 - bits)
                marks[(root * np.uint64(_MIX) >> shift).view(np.int64)] = True
                self.filters[size] = (marks, shift)

    @staticmethod
    def _keys(node: np.ndarray, word: np.ndarray, mix: int) -> np.ndarray:
        return (word ^ (node * np.uint64(_NODE))) * np.uint64(mix)

    def first(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Text i is ``data[offsets[i]:offsets[i + 1]]``."""
        best = np.full(len(offsets) - 1, self.empty, np.int64)
        words, offsets = bytes_ahead(data, offsets)
        total = int(offsets[-1])
        held = [np.empty(_BLOCK, np.uint64) for _ in range(2)]
        flags = np.empty(_BLOCK, bool)
        for at in range(0, total, _BLOCK):
            n = min(_BLOCK, total - at)
            here, key, marked = words[at : at + n].copy(), held[0][:n], flags[:n]
            found = []
            for size, (marks, shift) in self.filters.items():
                rest = np.uint64(8 * (EDGE - size))
                np.multiply(np.right_shift(np.left_shift(here, rest, out=key), rest, out=key), np.uint64(_MIX), out=key)
                np.right_shift(key, shift, out=held[1][:n])
                marks.take(held[1][:n].view(np.int64), out=marked, mode="clip")
                found.append((size, np.flatnonzero(marked)))
            for size, some in found:
                row = np.searchsorted(offsets, some + at, "right") - 1
                self._follow([(size, np.zeros(len(some), np.uint64), some + at, row, offsets[row + 1] - some - at)], words, best)
        return best

    def _follow(self, due: list[tuple], words: np.ndarray, best: np.ndarray) -> None:
        """``due``: bytes to look at, nodes, positions, texts and the bytes that are left of these."""
        while due:
            size, node, pos, row, room = due.pop()
            mix, keys, nodes, own, place, child = self.tables[size]
            word = words[pos] & np.uint64((1 << 8 * size) - 1)
            slot = np.minimum(np.searchsorted(keys, self._keys(node, word, mix)), len(keys) - 1)
            hit = np.flatnonzero((own[slot] == word) & (nodes[slot] == node) & (room >= size))
            np.minimum.at(best, row[hit], place[slot[hit]])
            if size == EDGE:
                hit = hit[(child[slot[hit]] > 0) & (room[hit] > EDGE)]
                if len(hit):
                    ahead = child[slot[hit]].astype(np.uint64), pos[hit] + EDGE, row[hit], room[hit] - EDGE
                    due.extend((s, *ahead) for s in self.tables)
