"""Near sets against brute force: Jaccard 0.8 or more."""

import random
import re

import pytest
from pyspark.sql import functions as F

from floodlens.llm import near_sets

from .test_dedup import groups


def near(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


@pytest.mark.parametrize("crowd", [2, 20])
def test_crowds_are_resolved_exactly(spark, crowd):
    """Bands that all sets share: pairs that no chain of centres ties are found too."""
    rng = random.Random(8)
    common = [rng.getrandbits(60) for _ in range(60)]
    sets = {}
    for _ in range(120):
        base = common + [rng.getrandbits(60) for _ in range(40)]
        for drift in (0, rng.choice([4, 8, 12])):
            sets[len(sets)] = sorted(set(base[drift:] + [rng.getrandbits(60) for _ in range(drift)]))
    held = spark.createDataFrame(list(sets.items()), "node long, shingles array<long>")
    banded = spark.createDataFrame([(i, 1) for i in sets], "node long, band long")
    have = {r.node: r.component for r in near_sets.near_components(banded, lambda ids: held.join(ids, "node"), crowd=crowd).collect()}
    as_sets = {i: set(s) for i, s in sets.items()}
    want = groups([(a, b) for a in sets for b in range(a) if near(as_sets[a], as_sets[b])], sets)
    assert len(set(want.values())) > 100 and {i: have.get(i, i) for i in sets} == want


def test_a_hot_band_is_dealt_over_tasks(spark):
    """200,000 members of one band: what its centres come from, and the pairs with them, lie in no single task."""
    members = spark.range(200_000).select(F.xxhash64("id").alias("node"), F.lit(1).cast("long").alias("band"))
    more = spark.range(50).select(F.col("id").alias("node"), (F.floor(F.col("id") / 2) + 10).cast("long").alias("band"))
    placed = near_sets._placed(members.unionByName(more))
    parts = placed.where("n > 64").withColumn("part", F.pmod(F.xxhash64("h"), F.ceil(F.col("n") / near_sets.PART)))
    assert parts.groupBy("part").count().agg(F.max("count")).first()[0] < 0.05 * 200_000
    centres = near_sets._centres(placed, 64)
    first = [r.node for r in placed.where("band = 1").orderBy("h", "node").limit(near_sets.CENTRES).collect()]
    assert sorted(r.v for r in centres.where("band = 1").collect()) == sorted(first)
    assert centres.where("band <> 1").count() == 50


def crowd_of(rng, sets):
    """Sets of many sizes around common shingles, half of them with a partner at or just below 0.8."""
    common = [rng.getrandbits(62) - (1 << 61) for _ in range(90)]
    out = []
    while len(out) < sets:
        base = common[:rng.randint(0, 90)] + [rng.getrandbits(62) - (1 << 61) for _ in range(rng.randint(1, 60))]
        n, kind = len(base), rng.randrange(4)
        if kind == 0:  # a part of the other, four fifths or one less
            out += [base, rng.sample(base, max(1, -(-n * 4 // 5) - rng.randrange(2)))]
        elif kind == 1:  # as many, eight ninths in common or one less
            kept = rng.sample(base, max(1, -(-n * 8 // 9) - rng.randrange(2)))
            out += [base, kept + [rng.getrandbits(61) for _ in range(n - len(kept))]]
        else:
            out.append(base)
    return {i: sorted(set(s)) for i, s in enumerate(out)}


@pytest.mark.parametrize("block", [3, 512])
def test_a_crowd_of_many_sizes(spark, monkeypatch, block):
    """Pairs of any two sizes are found, also those just at the bound, whatever the blocks."""
    monkeypatch.setattr(near_sets, "BLOCK", block)
    sets = crowd_of(random.Random(block), 240)
    held = spark.createDataFrame(list(sets.items()), "node long, shingles array<long>")
    as_sets = {i: set(s) for i, s in sets.items()}
    alone = spark.createDataFrame([], "node long, component long")
    placed = held.select("node", F.lit(1).cast("long").alias("band"), F.lit(len(sets)).alias("n"))
    have = {(max(r), min(r)) for r in near_sets._untied(placed, held, alone, 2).collect()}
    want = {(a, b) for a in sets for b in range(a) if near(as_sets[a], as_sets[b])}
    assert len(want) > 40 and want <= have
    halves = {i: i % 2 if i < 200 else i for i in sets}
    tied = spark.createDataFrame(list(halves.items()), "node long, component long")
    have = {(max(r), min(r)) for r in near_sets._untied(placed, held, tied, 2).collect()}
    assert {p for p in want if halves[p[0]] != halves[p[1]]} <= have and all(halves[a] != halves[b] for a, b in have)


def nodes(plan):
    kind = plan.getClass().getSimpleName()
    yield plan
    if kind == "AdaptiveSparkPlanExec":
        below = [plan.executedPlan()]
    elif kind.endswith("QueryStageExec"):
        below = [plan.plan()]
    else:
        below = [plan.children().apply(i) for i in range(plan.children().size())]
    for p in below:
        yield from nodes(p)


def test_a_crowd_is_not_taken_apart(spark, monkeypatch):
    """What is looked at in a crowd of loose members are their first shingles, not all, nor pairs of all that share one."""
    made = []

    def counted(write):
        def run(df):
            df.collect()
            for plan in nodes(df._jdf.queryExecution().executedPlan()):
                if re.search("Generate|Join", plan.nodeName()) and plan.metrics().contains("numOutputRows"):
                    made.append((plan.metrics().apply("numOutputRows").value(), plan.nodeName()))
            return write(df)

        return run

    monkeypatch.setattr(near_sets, "cut", counted(near_sets.cut))
    monkeypatch.setattr(near_sets, "cut_table", counted(near_sets.cut_table))
    rng = random.Random(3)
    common = [rng.getrandbits(60) for _ in range(60)]
    sets = {i: common + [rng.getrandbits(60) for _ in range(20)] for i in range(600)}
    sets[600] = sets[0][:-1]
    held = spark.createDataFrame(list(sets.items()), "node long, shingles array<long>")
    banded = held.select("node", F.lit(1).cast("long").alias("band"))
    have = near_sets.near_components(banded, lambda ids: held.join(ids, "node"), crowd=64).collect()
    assert {r.node: r.component for r in have} == {0: 0, 600: 0}
    assert made and max(made)[0] <= 0.3 * sum(map(len, sets.values())), max(made)
