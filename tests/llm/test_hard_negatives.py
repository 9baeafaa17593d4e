"""Hard negatives against brute force in whole numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from floodlens.llm import hard_negatives
from floodlens.llm.hard_negatives import PackedBlock

SCHEMA = "vec_id long, embedding array<double>, label int, score int, x int, block int"


def clamp(x):
    return max(-(1 << 63), min((1 << 63) - 1, x))


def brute(rows, every=50, scale=256):
    vectors = [(i, y, [math.floor(scale * c) for c in v]) for i, v, y in rows
               if i is not None and y is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = set()
    for anchor in sorted({i for i, _, _ in vectors if i % every == 0}):
        label, a = min((y, x) for i, y, x in vectors if i == anchor)
        scored = sorted((-clamp(sum(p * q for p, q in zip(a, x))), i, y) for i, y, x in vectors if i != anchor)
        for s, i, _ in [r for r in scored if r[2] == label][:5]:
            fits = [r for r in scored if r[2] != label and 50 * -s <= 100 * -r[0] <= 95 * -s][:3]
            out |= {(anchor, i, k, n, -s, -t) for k, (t, n, _) in enumerate(fits, 1)}
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(i, v, y, 0, 1, 2) for i, v, y in rows], SCHEMA)
    return sorted(map(tuple, hard_negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, **options).collect()))


@pytest.mark.parametrize("block, group", [(16, 3), (4096, 1024)])
def test_equals_brute_force(spark, block, group, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(hard_negatives, "ANCHOR_ROWS", group)
    rng = np.random.default_rng(9)
    centre = rng.normal(size=(4, 12))
    rows = [(int(i), (centre[i % 4] / 3 + rng.normal(size=12) / 4).tolist(), 0 if rng.random() < 0.4 else int(rng.integers(0, 6))) for i in rng.permutation(600)]
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(20)] + [(1100 + i, rows[1][1], 3) for i in range(20)]
    rows += [(2000, None, 0), (2050, [], 1), (2100, [None] * 12, 0), (2150, [float("nan")] * 12, 0), (2200, [float("inf")] * 12, 0), (None, rows[0][1], 0),
             (2250, [0.5] * 5, 2), (2300, [0.0] * 12, 0), (2350, [1.0] * 12, None), (2400, [-1.0] * 12, 77)]
    have = mined(spark, rows)
    assert have == brute(rows) and len(have) > 50


@pytest.mark.parametrize("rows", [
    [], [(50, [1.0], 1)], [(50, [1.0], 1), (51, [1.0], 1)], [(50, [1.0], 1), (51, [1.0], 1), (52, [0.6], 2), (53, [0.6], 2), (54, [0.99], 2)],
    [(0, [], 1), (1, [], 1), (2, [], 2)], [(0, [0.0], 1), (1, [0.0], 1), (2, [0.0], 2), (2, [0.0], 2)], [(0, [-1.0], 1), (1, [1.0], 1), (2, [0.7], 2)]])
def test_few_rows(spark, rows):
    assert mined(spark, rows) == brute(rows)


def test_great_components(spark):
    """Products beyond 63 bits are exact while the score is a long, and count as a long's end beyond."""
    for big in (3.0e4, 3.0e6, 3.0e13):
        rows = [(0, [big, -big, 1.0], 1), (1, [big, big - 1e3, 1.0], 1), (2, [big, big, 7.0], 2), (3, [big / 2, -big / 3, 0.0], 2), (4, [1.0, -2.0, 3.0], 2),
                (5, [9.0, -big, 0.0], 1), (6, [big / 3, -big / 2, 5.0], 3), (50, [-big, big, -1.0], 2)]
        assert mined(spark, rows) == brute(rows) != []
    huge = [(0, [1e300, 1e300], 1), (1, [1e300, 0.0], 1), (2, [-1e300, 5.0], 2), (3, [1.0, 1.0], 2)]
    assert mined(spark, huge) == []  # both positives end where a long does, and no negative lies between half and 0.95 of that


@pytest.mark.parametrize("reach", [1, 300, 1 << 20, 1 << 31, 1 << 45])
def test_packed_products_are_exact(reach):
    rng = np.random.default_rng(reach)
    x, anchors = rng.integers(-reach, reach + 1, (37, 9)), rng.integers(-reach, reach + 1, (5, 9))
    up = max(sum(c for c in a if c > 0) for a in anchors.tolist())
    down = max(-sum(c for c in a if c < 0) for a in anchors.tolist())
    block = PackedBlock(x, up, down)
    assert block.fields > 1
    for a in anchors:
        assert block.products(a).tolist() == [sum(p * q for p, q in zip(a.tolist(), row)) for row in x.tolist()]
    same = PackedBlock(np.full((3, 2), 1 << 61), 1 << 61, 0)
    assert same.products(np.array([1 << 60, 1 << 60])).tolist() == [1 << 122] * 3
