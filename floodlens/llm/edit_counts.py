"""Token counts that follow edits.

A document keeps a segment tree over its pre-tokens (the pieces that a byte-level vocabulary encodes on their own): leaves of
about ``LEAF`` pieces, and for every node the characters and the tokens below it. An edit leads down to the leaf where it
begins; pieces are cut anew from there, in the new text, until a cut falls on the old border of a leaf behind the edit. From
that border on the text is as it was, and so are its pieces. Only the pieces in between are encoded, and the sums on the way
up are updated.

A piece looks at most ``CONTEXT`` characters past its end, so cutting starts in the leaf that holds the character so far
before the edit. A text whose pieces the library alone can tell (see :mod:`floodlens.llm.encoding`) is one leaf and is
encoded whole.

Defined results: null texts are empty and have no token; an edit's place and length are held to the text as it is when its
turn comes; a null replacement is empty; a null or empty list of edits changes nothing; edits apply in the order of the list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from floodlens.llm import encoding
from floodlens.llm.common import in_arrow

TOKENIZER = "byte_bpe_50k.json"
LEAF = 64
#: A leaf that edits have made longer than this is cut up again with its tree.
LONG_LEAF = 8 * LEAF
CONTEXT = 2
TREE = StructType().add("chars", ArrayType(IntegerType())).add("tokens", ArrayType(IntegerType()))
EDIT = "struct<start: int, length: int, text: string>"


class CountTree:
    """Characters and tokens of a text by leaf and in sums; node 1 is the root, node i has the children 2i and 2i + 1."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.chars, self.tokens = chars, tokens
        self.size = len(chars) // 2

    @classmethod
    def of_leaves(cls, chars: np.ndarray, tokens: np.ndarray) -> CountTree:
        size = 1 << max(0, len(chars) - 1).bit_length()
        sums = []
        for leaves in (chars, tokens):
            tree = np.zeros(2 * size, dtype=np.int64)
            tree[size:size + len(leaves)] = leaves
            low, high = size, 2 * size
            while low > 1:
                tree[low // 2:low] = tree[low:high:2] + tree[low + 1:high:2]
                low, high = low // 2, low
            sums.append(tree)
        return cls(*sums)

    @classmethod
    def of_text(cls, text: str, encoder: encoding.PieceEncoder) -> CountTree:
        if not text or not encoder.plain(text):
            return cls.of_leaves(np.array([len(text)]), np.array([len(encoder.whole(text)) if text else 0]))
        pieces = encoder.find(text)
        first = np.arange(0, len(pieces), LEAF)
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        return cls.of_leaves(np.add.reduceat(lengths, first), np.add.reduceat(encoder.piece_lengths(pieces), first))

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[1])

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, the last with any if it lies behind them, and where the leaf starts."""
        node, start = 1, 0
        place = max(0, min(place, int(self.chars[1]) - 1))
        while node < self.size:
            left = int(self.chars[2 * node])
            if place - start < left:
                node = 2 * node
            else:
                node, start = 2 * node + 1, start + left
        return node - self.size, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.size
        for sums, value in ((self.chars, chars), (self.tokens, tokens)):
            change, at = value - int(sums[node]), node
            while at:
                sums[at] += change
                at //= 2


def edit(text: str, tree: CountTree, start: int, length: int, new: str, encoder: encoding.PieceEncoder) -> tuple[str, CountTree, int]:
    """The edited text, its tree (the same one, updated, if that was possible) and the number of pieces encoded for it (of ids if it is encoded whole)."""
    start = max(0, min(start, len(text)))
    length = max(0, min(length, len(text) - start))
    after = text[:start] + new + text[start + length:]
    touched = after[max(0, start - CONTEXT):start + len(new) + CONTEXT]
    alone = tree.size == 1 and not encoder.plain(text)
    if not text or not after or alone or encoding.UNUSUAL.search(touched) or encoder.pattern is None:
        tree = CountTree.of_text(after, encoder)
        return after, tree, len(encoder.find(after)) if encoder.plain(after) else tree.n_tokens
    shift = len(new) - length
    leaf, begin = tree.leaf_at(start - CONTEXT)
    # Old borders of leaves behind the edit, one after another.
    last, border = leaf, begin + int(tree.chars[tree.size + leaf])
    leaves = tree.size
    pieces, at, done = [], begin, False
    for match in encoder.pattern.finditer(after, begin):
        while at >= start + len(new) and border + shift < at and last + 1 < leaves:
            last += 1
            border += int(tree.chars[tree.size + last])
        if at >= start + len(new) and border >= start + length and border + shift == at:
            done = True
            break
        pieces.append(match.group())
        at = match.end()
    if not done:
        last = leaves - 1
    tokens = int(encoder.piece_lengths(pieces).sum()) if pieces else 0
    tree.put(leaf, at - begin, tokens)
    for other in range(leaf + 1, last + 1):
        if tree.chars[tree.size + other] or tree.tokens[tree.size + other]:
            tree.put(other, 0, 0)
    if len(pieces) > LONG_LEAF:
        tree = CountTree.of_text(after, encoder)
    return after, tree, len(pieces)


def _tree_array(trees: list[CountTree]) -> pa.StructArray:
    offsets = pa.array(np.cumsum([0, *(2 * t.size for t in trees)]).astype(np.int32))
    sums = [np.concatenate([getattr(t, n) for t in trees]).astype(np.int32) if trees else np.empty(0, np.int32) for n in ("chars", "tokens")]
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(s)) for s in sums], ["chars", "tokens"])


def with_trees(docs: DataFrame, text_col: str = "text", tree_col: str = "tree", tokenizer: str = TOKENIZER) -> DataFrame:
    """``docs`` with the tree of each text in a column of its own (replacing one of that name)."""
    docs = docs.drop(tree_col)
    names = docs.columns
    at = names.index(text_col)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding.encoder(tokenizer)
        for batch in batches:
            trees = [CountTree.of_text(t.as_py() or "", encoder) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, _tree_array(trees)], [*names, tree_col])

    return in_arrow(docs, build, StructType([*docs.schema.fields, StructField(tree_col, TREE)]))


def apply_edits(docs: DataFrame, edits: str | Column, text_col: str = "text", tree_col: str = "tree", tokenizer: str = TOKENIZER) -> DataFrame:
    """Edit texts and their trees in place; adds ``n_tokens_before, n_tokens, n_encoded`` (pieces encoded for the edits, ids of texts encoded whole).

    ``edits`` is a list of ``start, length, text`` (characters to replace and what by). The result can be edited again.
    """
    added = ["n_tokens_before", "n_tokens", "n_encoded"]
    names = [c for c in docs.columns if c not in added]
    own = "edits"
    while own in map(str.lower, names):
        own += "_"
    rows = docs.select(*names, (F.col(edits) if isinstance(edits, str) else edits).cast(f"array<{EDIT}>").alias(own))
    text_at, tree_at = names.index(text_col), names.index(tree_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding.encoder(tokenizer)
        for batch in batches:
            texts, trees, before, encoded = [], [], [], []
            stored = batch.column(tree_at)
            sums = [stored.field(n) for n in ("chars", "tokens")]
            for i, (text, changes) in enumerate(zip(batch.column(text_at).to_pylist(), batch.column(len(names)).to_pylist())):
                tree = CountTree(*(s[i].values.to_numpy(zero_copy_only=False).astype(np.int64) for s in sums))
                before.append(tree.n_tokens)
                n = 0
                for change in changes or ():
                    if change is not None:
                        text, tree, k = edit(text or "", tree, change["start"] or 0, change["length"] or 0, change["text"] or "", encoder)
                        n += k
                texts.append(text)
                trees.append(tree)
                encoded.append(n)
            columns = list(batch.columns[:-1])
            columns[text_at], columns[tree_at] = pa.array(texts, pa.string()), _tree_array(trees)
            counts = (before, [t.n_tokens for t in trees], encoded)
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, pa.int64()) for c in counts)], [*names, *added])

    schema = docs.select(*names).schema
    for name in added:
        schema = schema.add(name, "long")
    return in_arrow(rows, run, schema)
