"""Periodic runs against a plain search, and the query's digests."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from floodlens.llm import periodic_runs
from floodlens.llm.queries import QUERIES


def brute_runs(words, least=6, times=4):
    """All stretches (start, end, smallest period), by trying every period from the least on."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, times * q):
                found.setdefault((start, i + q), q)
    return sorted((s, e, q) for (s, e), q in found.items())


def same(texts):
    for text, (words, runs) in zip(texts, periodic_runs.runs_of_texts(texts), strict=True):
        assert words == text.encode().split()
        assert sorted(map(tuple, runs.tolist())) == brute_runs(words), text


@pytest.mark.parametrize("longest", [4, 4096])
def test_runs_equal_brute_force(longest, monkeypatch):
    monkeypatch.setattr(periodic_runs, "LONGEST", longest)
    rng = random.Random(longest)
    for _ in range(120):
        texts = []
        for _ in range(rng.randint(1, 5)):
            words = [rng.choice("abcdefgh"[:rng.randint(1, 8)]) for _ in range(rng.choice([0, 1, 5, 6, 7, 30, 90, 250]))]
            if words and rng.random() < 0.6:
                a, p = rng.randrange(len(words)), rng.randint(1, max(1, len(words) // 4))
                words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            texts.append(" ".join(words))
        same(texts)


def test_sums_of_squared_differences_are_exact():
    rng = np.random.default_rng(3)
    for length in (2, 4, 16, 64, 128, 512, 4096):
        most = periodic_runs.largest(length)
        blocks = rng.integers(0, most + 1, (3, length)).astype(float)
        blocks[2] = most
        windows = rng.integers(0, most + 1, (3, 2 * length)).astype(float)
        windows[1, 1:1 + length] = blocks[1]
        windows[2] = most
        got = periodic_runs.mismatches(blocks, windows, length)
        want = [[((b - w[d:d + length]) ** 2).sum() for d in range(length)] for b, w in zip(blocks, windows)]
        assert (got == want).all() and got[1, 1] == 0 and not got[2].any()


def test_hash_accidents_change_nothing(monkeypatch):
    """All words alike to the hash: the stretches are found word by word."""
    monkeypatch.setattr(periodic_runs, "_mixed", lambda ids: np.ones(len(ids), dtype=np.uint64))
    same(["a b a b a b a b a b c", "x x x x x x x", "", "a b c a b c a b c a b c d"])


def test_long_text_with_a_long_period():
    rng = random.Random(7)
    period = [str(rng.random()) for _ in range(9_000)]
    words = ["start"] * 3 + (period * 5)[:40_000] + ["end"]
    runs = list(periodic_runs.runs_of_texts([" ".join(words)]))[0][1]
    assert runs.tolist() == [[3, 40_003, 9_000]]
    assert periodic_runs.collapse([w.encode() for w in words], runs).decode().split() == ["start"] * 3 + period + ["end"]


DOCS = "doc_id long, text string, runs int, collapsed string, n_words int, words string"


def test_defined_results(spark):
    rows = [(1, "a b " * 6, 0, "", 0, ""), (None, "c " * 9, 0, None, 0, ""), (2, None, 0, "", 0, ""), (3, "", 0, "", 0, ""), (3, "", 0, "", 0, ""),
            (4, "x\x0by\x0cz\x85w 　 x", 0, "", 0, ""), (5, "q " * 50_000 + "r", 0, "", 0, ""), (6, "a a a a a", 0, "", 0, "")]
    found = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.periodic_runs(spark.createDataFrame(rows, DOCS)).collect()))
    assert found == [
        (0, 9, [(0, 9, 1)], "c"), (1, 12, [(0, 12, 2)], "a b"), (2, 0, [], ""), (3, 0, [], ""), (3, 0, [], ""),
        (4, 5, [], "x y z\x85w 　 x"), (5, 50_001, [(0, 50_000, 1)], "q r"), (6, 5, [], "a a a a a")]
    assert periodic_runs.periodic_runs(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(np.array([1]), np.array([0, 1]), times=3)


def test_query_equals_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op11_periodic_runs"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    planted = 0
    for r in rows:
        words = (docs[r.doc_id] or "").encode().split()
        h = zlib.crc32(str(r.doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        if n > 3000:
            continue  # the plain search is quadratic
        runs = sorted(brute_runs(words), key=lambda x: (x[0], x[2]))
        keep = set(range(n))
        for s, e, q in runs:
            keep -= set(range(s + q, e))
        lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
        best = min(((-Fraction(e - s, q), s, q, e - s) for s, e, q in runs), default=None)
        want = (None,) * 4 if best is None else (best[1], best[3], best[2], 1000 * best[3] // best[2])
        assert (r.n_runs, (r.start, r.length, r.period, r.exponent_milli)) == (len(runs), want)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(words[i] for i in sorted(keep))).hexdigest()
    assert planted > 10
