"""Exact top-k and mixing against SQL and brute force, with their defined results."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from floodlens.llm import mixing, pivot_search


def brute_top(rows, every=100, k=10):
    vectors = [(i, [math.floor(1024 * float(np.float32(c))) for c in v]) for i, v in rows
               if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for q, x in {i: x for i, x in vectors if i % every == 0}.items():
        scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in vectors if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("block", [8, 2048])
def test_top_k_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(pivot_search, "BLOCK_ROWS", block)
    monkeypatch.setattr(pivot_search, "QUERY_ROWS", 3)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 12))
    rows = [(int(i), (centres[i % 6] * rng.uniform(0.2, 2) + 0.1 * rng.normal(size=12)).astype(np.float32).tolist(), 0) for i in rng.permutation(700)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(60)]  # one vector many times
    rows += [(2000, None, 0), (2100, [], 0), (2200, [None] * 12, 0), (2300, [float("nan")] * 12, 0), (2400, [float("inf")] * 12, 0), (None, rows[0][1], 0),
             (2500, [0.5] * 5, 0), (2600, [0.0] * 12, 0), (2601, [-1.0] * 12, 0)]
    have = pivot_search.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, have.collect())) == brute_top([r[:2] for r in rows])


@pytest.mark.parametrize("rows", [[], [(100, None, 1)], [(100, [1.0, 2.0], 1)], [(100, [1.0], 1), (200, [1.0], 1), (7, [-1.0], 2)], [(0, [0.0, 0.0], 0), (1, [0.0, 0.0], 0)]])
def test_top_k_of_few(spark, rows):
    have = pivot_search.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, have.collect())) == brute_top([r[:2] for r in rows])


def test_index_leaves_blocks_out(spark):
    """Clustered vectors: the bounds spare most annuli."""
    rng = np.random.default_rng(1)
    centres = 5 * rng.normal(size=(20, 8))
    rows = [(i, (centres[i % 20] + 0.05 * rng.normal(size=8)).tolist(), 0) for i in range(4000)]
    vectors = pivot_search.whole_numbers(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding")
    index = pivot_search.PivotIndex(vectors, pivots=20)
    bounds = index._bounds()(np.array([[math.floor(1024 * c) for c in rows[3][1]]], dtype=float))
    assert (bounds > 1000).mean() > 0.5


@pytest.mark.parametrize("size", [3e7, 1e10, 2.0**40, 1e300])
def test_great_components(spark, size):
    """Exact beyond what doubles hold; scores beyond a long count as its ends."""
    rng = np.random.default_rng(2)
    rows = [(i, (size * np.round(rng.uniform(-1, 1, 4), 6)).tolist(), 0) for i in range(0, 400, 4)] + [(1, [1.0, 2.0, 3.0, 4.0], 0), (2, [size, 0.0, 0.0, 1.0], 0)]
    have = sorted(map(tuple, pivot_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") % 100 == 0).collect()))
    low, high = -(1 << 63), (1 << 63) - 1
    clamp = lambda x: max(low, min(high, x))
    whole = {i: [clamp(math.floor(min(max(1024 * c, float(low)), float(high)))) for c in v] for i, v, _ in rows}
    want = []
    for q in (i for i in whole if i % 100 == 0):
        scored = sorted((-clamp(sum(a * b for a, b in zip(whole[q], y))), i) for i, y in whole.items() if i != q)
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:10], 1)]
    assert have == sorted(want)


def test_products_equal_whole_numbers():
    rng = np.random.default_rng(4)
    for reach in (10, 1 << 20, 1 << 30, 1 << 45, 1 << 62):
        a, b = rng.integers(-reach, reach, (5, 6)), rng.integers(-reach, reach, (7, 6))
        clamp = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
        assert pivot_search.products(a, b).tolist() == [[clamp(sum(p * q for p, q in zip(x, y))) for y in b.tolist()] for x in a.tolist()]


DOCS = "doc_id long, text string, source string"


def mix_both(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    have = sorted(map(repr, (tuple(r) for r in mixing.mix_report(docs).select("doc_id", "size", "source_size", "target", "taken").collect())))
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    db.executemany("insert into documents values (?, ?, ?)", rows) if rows else None
    want = sorted(map(repr, db.execute(mixing.mix_sql()).fetchall()))
    return docs, have, want


def test_mix_equals_sql_and_meets_targets(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.choice([0, 1, 5, 40, 300]), rng.choice(["a", "b", "b", "b", "c", "d", "é", "B", None])) for i in range(3000)]
    rows += [(5000, None, "a"), (5001, "", None), (None, "x y", "a"), (5002, "long " * 50_000, "tiny"), (5003, "\x0bt w\x0co\x85x", "z"), (5003, "\x0bt w\x0co\x85x", "z")]
    docs, have, want = mix_both(spark, rows)
    assert have == want
    report = mixing.mix_report(docs).join(docs, "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most"))
    for r in report.where("source <> 'z' and source is not null and source <> 'a'").collect():
        assert abs(r.taken - r.target) <= 1.2 * r.most + 1
    mixed = mixing.mix(docs.selectExpr("*", "1 as size", "2 as copies", "3 as part", "4 as target", "5 as row"))
    assert mixed.columns[:3] == ["doc_id", "text", "source"] and mixed.columns[3:] == ["size", "copies", "part", "target", "row"]
    emitted = mixed.groupBy("doc_id").agg(F.count("*").alias("k")).where("doc_id <> 5003").collect()
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix_report(docs).collect() if r.size}
    assert all(taken.get(r.doc_id, r.k) == r.k <= 3 for r in emitted if r.doc_id is not None)


@pytest.mark.parametrize("rows", [
    [], [(1, None, None)], [(1, "", "a"), (2, "", "b")], [(1, "a b", "x")], [(1, "a b c", "x"), (2, "a", "y"), (3, "a", "z"), (4, "a", None)],
    [(1, "w " * 100, "p"), (2, "w", "q"), (3, "w", "r"), (4, "w", "s")]])
def test_mix_of_few(spark, rows):
    _, have, want = mix_both(spark, rows)
    assert have == want


def test_targets_share_all_words(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 10), ("d", 500), (None, 5)], "source string, size long")
    rows = {r.source: r for r in mixing.targets(sizes).collect()}
    assert sum(r.target for r in rows.values()) == pytest.approx(1525)
    assert all(r.target <= 3 * r.source_size + 1e-9 for r in rows.values())
    assert rows["b"].target == 30 and rows["c"].target == 30 and rows[None].target == 15
    assert rows["a"].target / 5 == pytest.approx(rows["d"].target / 5)
