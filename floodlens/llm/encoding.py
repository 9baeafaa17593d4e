"""Token ids of whole texts with a public tokenizer file, at corpus speed.

A tokenizer of the ``tokenizers`` library first cuts a text into pieces and then encodes every piece on its own. Running
text repeats its pieces, so :class:`PieceEncoder` cuts texts with the same rule, lets the library encode each piece once and
looks the ids up afterwards. Texts whose cut could depend on more than that rule (unusual scripts, control characters,
letters not in composed form, the tokenizer's own special strings) are handed to the library whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence

import numpy as np

from floodlens.llm.common import held

# Letters and numerals of the Latin blocks up to U+024F, as Unicode classifies them.
LATIN_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
LATIN_NUMBER = "0-9²³¹¼-¾"
SPACE = " \t\n\r"

# How the two public vocabularies cut a text before merging.
BYTE_PIECES = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN_LETTER}]+| ?[{LATIN_NUMBER}]+| ?[^{SPACE}{LATIN_LETTER}{LATIN_NUMBER}]+"
    rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
WORD_PIECES = (
    rf"'[sStTmMdD]|'[rR][eE]|'[vV][eE]|'[lL][lL]|[{LATIN_LETTER}]+|[{LATIN_NUMBER}]|[^{SPACE}{LATIN_LETTER}{LATIN_NUMBER}]+"
)
PIECES = {"byte_bpe_50k.json": BYTE_PIECES, "word_bpe_49k.json": WORD_PIECES}

#: Anything else than printable Latin text and common punctuation; a dotted capital I changes length in lower case.
UNUSUAL = re.compile("[^\t\n\r -~¡-įı-ɏ‐-‧‰-⁞€™]|<\\|")

def _byte_characters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as one visible character: itself if it is visible, else the next from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(0x100)) - set(visible))
    return {b: chr(b) for b in visible} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


BYTE_CHARACTERS = _byte_characters()

#: Distinct pieces remembered by one Python worker; beyond it the memory starts anew (results do not change).
REMEMBERED = 600_000
#: Characters of text handled at once.
CHUNK_CHARS = 1_000_000


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file, on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Codes(dict):
    """Piece -> position, handing out new positions as pieces appear."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []
        self.size = 0

    def __missing__(self, piece: str) -> int:
        self[piece] = code = self.size
        self.size += 1
        self.new.append(piece)
        return code


class PieceEncoder:
    """Encodes texts with the tokenizer file ``name``; equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, name: str, path: str | None = None, remembered: int = REMEMBERED) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path or vocabulary(name))
        self.pattern = re.compile(PIECES[name]) if name in PIECES else None
        self.find = self.pattern.findall if self.pattern else None
        self.lower = name == "word_bpe_49k.json"
        self.remembered = remembered
        self._forget()

    def _forget(self) -> None:
        self.codes = _Codes()
        self.flat = np.empty(1 << 16, dtype=np.int32)
        self.used = 0
        self.offset = np.empty(1 << 14, dtype=np.int64)
        self.length = np.empty(1 << 14, dtype=np.int64)

    def plain(self, text: str) -> bool:
        return self.find is not None and not UNUSUAL.search(text) and unicodedata.is_normalized("NFC", text)

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _store(self, first: int, encoded: Iterable[Sequence[int]]) -> None:
        encoded = [np.asarray(x, dtype=np.int32) for x in encoded]
        lengths = np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded))
        total, last = int(lengths.sum()), first + len(encoded)
        while self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        while last > len(self.offset):
            self.offset, self.length = np.resize(self.offset, 2 * len(self.offset)), np.resize(self.length, 2 * len(self.length))
        if total:
            self.flat[self.used:self.used + total] = np.concatenate(encoded)
        self.offset[first:last] = self.used + np.cumsum(lengths) - lengths
        self.length[first:last] = lengths
        self.used += total

    def _learn(self) -> None:
        if new := self.codes.new:
            first = self.codes.size - len(new)
            if self.lower:
                new = [x.lower() for x in new]
            merge = self.library.model.tokenize
            self._store(first, [[t.id for t in merge(x.encode().decode("latin-1").translate(BYTE_CHARACTERS))] for x in new])
            self.codes.new = []

    def piece_codes(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all pieces of ``texts`` in order, and the number of pieces of each text."""
        if len(self.codes) > self.remembered:
            self._forget()
        codes: list[int] = []
        counts = np.zeros(len(texts), dtype=np.int64)
        lookup = self.codes.__getitem__
        for i, text in enumerate(texts):
            before = len(codes)
            if self.plain(text):
                codes.extend(map(lookup, self.find(text)))
            elif text:
                self._learn()
                codes.append(self.codes.size)
                self._store(self.codes.size, [self.whole(text)])
                self.codes.size += 1
            counts[i] = len(codes) - before
        self._learn()
        return np.asarray(codes, dtype=np.int64), counts

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` one after another, and the number of ids of each text."""
        codes, pieces = self.piece_codes(texts)
        lengths = self.length[codes]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.offset[codes] - (ends - lengths), lengths) + np.arange(total)] if total else np.empty(0, np.int32)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(pieces)])]
        return ids, np.diff(bounds)

    def piece_lengths(self, pieces: Sequence[str]) -> np.ndarray:
        """Number of ids of each piece that ``find`` cut out."""
        if len(self.codes) > self.remembered:
            self._forget()
        codes = list(map(self.codes.__getitem__, pieces))
        self._learn()
        return self.length[np.asarray(codes, dtype=np.int64)]


def encoder(name: str, path: str | None = None) -> PieceEncoder:
    """The encoder of this Python process."""
    return held(("encoder", name, path), lambda: PieceEncoder(name, path))


def chunks(texts: Sequence[str | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Runs of consecutive texts of about ``limit`` characters, each with the place of its first; null becomes empty."""
    start, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text or "")
        size += len(held[-1])
        if size >= limit:
            yield start, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, held
