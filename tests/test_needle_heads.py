"""Heads of long needle lists: the trie against brute force, heads and index together, no text taken apart that a head settles."""

import random

import numpy as np
import pytest

from floodlens.operators import needle_grams
from floodlens.operators import needles as long_lists
from floodlens.operators.needle_trie import NeedleTrie

NEEDLES = "needle string, label string, rank int"


def test_trie_equals_brute_force():
    rng = random.Random(3)
    for alphabet in ("ab", "abcé", "x", "abñ日") * 25:
        word = lambda n: "".join(rng.choice(alphabet) for _ in range(n)).encode()
        texts = [word(rng.choice([0, 1, 3, 9, 20, 60])) for _ in range(40)]
        needles = [word(rng.choice([1, 2, 3, 5, 7, 8, 9, 12, 16, 17, 24, 33])) for _ in range(rng.choice([0, 1, 5, 40]))] + [b""] * (rng.random() < 0.1)
        want = [min((i for i, n in enumerate(needles) if n in t), default=len(needles)) for t in texts]
        skip = rng.randrange(20)
        offsets = np.cumsum([0] + [len(t) for t in texts])[skip:]
        assert NeedleTrie(needles).first(np.frombuffer(b"".join(texts), np.uint8), offsets).tolist() == want[skip:]


def test_trie_takes_long_needles_and_texts():
    texts, needles = [b"x" * 70_000 + b"end", b"x" * 20_000, b"", b"end"], [b"x" * 30_000 + b"end", b"x" * 20_001, b"x" * 20_000]
    offsets = np.cumsum([0] + [len(t) for t in texts])
    assert NeedleTrie(needles).first(np.frombuffer(b"".join(texts), np.uint8), offsets).tolist() == [0, 2, 3, 3]


@pytest.mark.parametrize("heads", [(), (1,), (3, 40), (150, 300)])
def test_heads_and_index_equal_brute_force(spark, monkeypatch, heads):
    monkeypatch.setattr(long_lists, "HEADS", heads)
    monkeypatch.setattr(long_lists, "STEP", 2)
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdé ñ") for _ in range(n))
    texts = [(i % 90, word(rng.choice([0, 1, 3, 20, 80]))) for i in range(120)] + [(200, None), (201, "日本語テキスト"), (201, None), (None, "abc abc abc"), (None, "a")]
    needles = [(word(rng.randint(1, 19)), f"l{rng.randrange(5)}", rng.randrange(40)) for _ in range(150)]
    needles += [("本語", "jp", 3), ("本語", None, 3), (None, "none", 0), ("y" * 5_000, "long", 0), ("zzzzzz", "nowhere", 0), ("b", None, None)]
    rows = spark.createDataFrame(texts, "id long, text string")
    have = long_lists.first_mentions(rows, "id", "text", spark.createDataFrame(needles, NEEDLES), "other").collect()
    want = {}
    for i in {i for i, _ in texts}:
        t = max((t for k, t in texts if k == i and t is not None), key=str.encode, default=None)
        hits = [(r, s or "", s) for n, s, r in needles if None not in (n, r, t, i) and n in t]
        want[i] = (min(hits)[0], min(hits)[2] or "other") if hits else (None, "other")
    assert len(have) == len(want) and {r.id: (r.rank, r.label) for r in have} == want


def test_rarest_and_marked_windows():
    texts, needles = [b"abcabc", b"", b"xabcdefgh", "ñandú".encode()], [b"abc", b"ab", b"bcdefghi", b"abcdefgh", b"", "dú".encode(), b"zz", b"xabcdefghij"]
    offsets, data = np.cumsum([0] + [len(t) for t in texts]), np.frombuffer(b"".join(texts), np.uint8)
    own, cut = np.cumsum([0] + [len(n) for n in needles]), np.frombuffer(b"".join(needles), np.uint8)
    counts = np.zeros(1 << needle_grams.COUNTED_BITS, np.int64)
    needle_grams.count_windows(data, offsets, [2, 3, 8], counts)
    row, keys = needle_grams.rarest_windows(cut, own, 8, counts)
    assert row.tolist() == [0, 1, 3, 5]
    marks = np.zeros(1 << 13, np.uint8)
    at = (keys >> np.uint64(48)).astype(np.int64)
    np.bitwise_or.at(marks, at >> 3, (1 << (at & 7)).astype(np.uint8))
    met = {(int(i), int(k)) for rows, found in needle_grams.marked_windows(data, offsets, [2, 3, 8], marks) for i, k in zip(rows, found) if k in keys}
    assert met == {(i, int(k)) for i, t in enumerate(texts) for r, k in zip(row, keys) if needles[r] in t}


def test_no_text_is_taken_apart_that_a_head_settles(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("a settled text is taken apart")

    monkeypatch.setattr(long_lists, "_text_grams", refuse)
    texts = spark.createDataFrame([(i, f"every text number {i}") for i in range(50)], "id long, text string")
    needles = spark.createDataFrame([("number", "all", 1)] + [(f"number {i}", "one", 100 + i) for i in range(500)], NEEDLES)
    assert {(r.rank, r.label) for r in long_lists.first_mentions(texts, "id", "text", needles).collect()} == {(1, "all")}
