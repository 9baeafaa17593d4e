"""As-of bracketing, carry-forward and the tide model against brute force."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from floodlens.functions.tide_model import with_harmonic_tide
from floodlens.operators import payloads, series

T0 = dt.datetime(2024, 1, 1)


def minute(m):
    return T0 + dt.timedelta(minutes=m)


@pytest.mark.parametrize("slot_hours, per_span", [(1.0, 1000), (24.0, 2), (2400.0, 1000), (0.1, 7)])
def test_bracket_against_brute_force(spark, monkeypatch, slot_hours, per_span):
    monkeypatch.setattr(series, "SLOTS_PER_SPAN", per_span)
    rng = random.Random(11)
    # One station holds a third of the rows; instants repeat; some stations have no events.
    station = lambda: "hot" if rng.random() < 0.34 else f"s{rng.randrange(6)}"
    events = [(station(), minute(rng.randrange(0, 9000, 5)), rng.randrange(0, 40) / 10) for _ in range(700)]
    events = [e for e in events if e[0] != "s5"]
    probes = [(i, station(), minute(rng.randrange(-100, 9200, 5))) for i in range(900)]
    pdf = spark.createDataFrame(probes, "id INT, station STRING, ts TIMESTAMP")
    edf = spark.createDataFrame(events, "station STRING, ts TIMESTAMP, height_m DOUBLE")
    got = {r.id: (r.t0, r.h0, r.t1, r.h1) for r in series.bracket(pdf, edf, "station", slot_hours=slot_hours).collect()}
    us = lambda t: int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    for i, s, t in probes:
        before = [(e[1], e[2]) for e in events if e[0] == s and e[1] <= t]
        after = [(e[1], -e[2]) for e in events if e[0] == s and e[1] > t]
        b, a = (max(before) if before else None), (min((x[0], -x[1]) for x in after) if after else None)
        assert got[i] == (us(b[0]) if b else None, b[1] if b else None, us(a[0]) if a else None, a[1] if a else None)
    assert len(got) == len(probes)


def test_bracket_plan_is_not_a_theta_join(spark):
    pdf = spark.createDataFrame([(1, "s", T0)], "id INT, station STRING, ts TIMESTAMP")
    edf = spark.createDataFrame([("s", T0, 1.0)], "station STRING, ts TIMESTAMP, height_m DOUBLE")
    plan = series.bracket(pdf, edf, "station")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_interpolation_and_fallback(spark):
    edf = spark.createDataFrame([("s", minute(0), 1.0), ("s", minute(60), 3.0), ("s", minute(120), 3.0)], "station STRING, ts TIMESTAMP, height_m DOUBLE")
    probes = spark.createDataFrame([(0, "s", minute(0)), (1, "s", minute(55)), (2, "s", minute(90)), (3, "s", minute(120)), (4, "t", minute(5))], "id INT, station STRING, ts TIMESTAMP")
    rows = {r.id: r for r in series.interpolate(series.bracket(probes, edf, "station")).collect()}
    assert (rows[0].height_m, rows[0].trend, rows[0].high_tide) == (1.0, "subiendo", False)
    assert (rows[1].height_m, rows[1].high_tide) == (2.833, True)
    assert (rows[2].height_m, rows[2].trend) == (3.0, "bajando")  # equal heights count as falling
    assert rows[3].height_m is None and rows[4].trend is None
    full = {r.id: r for r in series.tide_with_fallback(series.bracket(probes, edf, "station")).collect()}
    assert full[1].origin == "INOCAR_pdf" and full[4].origin == "modelo_armonico_fallback"
    hours = (minute(5) - dt.datetime(1970, 1, 1)).total_seconds() / 3600
    height = 1.8 + 1.4 * math.sin(2 * math.pi * hours / 12.42) + 0.4 * math.sin(2 * math.pi * hours / 12.0)
    assert full[4].height_m == round(height, 3)


def test_harmonic_flags(spark):
    rows = with_harmonic_tide(spark.createDataFrame([(minute(37 * i),) for i in range(200)], "ts TIMESTAMP"), "ts", "m").select("ts", "m.*").collect()
    for r in rows:
        h = (r.ts - dt.datetime(1970, 1, 1)).total_seconds() / 3600
        at = lambda x: 1.8 + 1.4 * math.sin(2 * math.pi * x / 12.42) + 0.4 * math.sin(2 * math.pi * x / 12.0)
        assert abs(r.height_m - at(h)) <= 5.1e-4
        assert r.trend == ("subiendo" if at(h + 1) > at(h) else "bajando")
        assert r.high_tide == (at(h) >= 2.8)


@pytest.mark.parametrize("width, per_span", [(1, 1000), (7, 1000), (1000, 1000), (1, 5)])
def test_carry_forward_over_slots(spark, monkeypatch, width, per_span):
    """One key holds a third of the rows and a fifth of these stand at one instant."""
    monkeypatch.setattr(series, "SLOTS_PER_SPAN", per_span)
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "b", None]), i if rng.random() < 0.8 else 200, rng.choice([None, None, None, float(i)])) for i in range(400)]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n INT, k STRING, i INT, v DOUBLE")
    out = series.carry_forward(df, ["k"], ["i"], "v", F.floor(F.col("i") / width), "f")
    got = {r.n: r.f for r in out.collect()}
    assert len(got) == len(rows)
    for n, (k, i, _) in enumerate(rows):
        known = [(j, x) for q, j, x in rows if q == k and j <= i and x is not None]
        assert got[n] == (max(known)[1] if known else None)


def test_carry_forward_without_keys(spark):
    df = spark.createDataFrame([(i, float(i) if i % 40 == 0 else None) for i in range(200)], "i INT, v DOUBLE")
    out = series.carry_forward(df, [], ["i"], "v", F.col("i"), "f").collect()
    assert all(r.f == r.i // 40 * 40 for r in out)


def test_series_plans_start_no_job(spark):
    """Building the plans reads nothing: no counts, no checkpoints."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("series-plan", "plan only")
    df = spark.range(1000).selectExpr("id", "id % 3 AS k", "cast(id AS timestamp) AS ts", "cast(id AS double) AS height_m")
    series.carry_forward(df, ["k"], ["id"], "height_m", F.col("id"), "f")
    series.bracket(df, df, "k")
    assert not tracker.getJobIdsForGroup("series-plan")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_last_days_and_merge(spark):
    day = lambda i: dt.date(2024, 1, i)
    base = spark.createDataFrame([(day(i), float(i)) for i in (1, 2, 2, 4, 5, 6, 7)], "date DATE, zos DOUBLE")
    other = spark.createDataFrame([(day(i), float(i) * 10) for i in (1, 4, 4, 9)], "date DATE, so DOUBLE")
    rows = payloads.merge_daily(base, [(other, {"so": "so"})], {"zos": "zos"}, n_days=5).orderBy("date").collect()
    assert [(r.date.day, r.zos, r.so) for r in rows] == [(2, 2.0, None), (4, 4.0, 40.0), (5, 5.0, None), (6, 6.0, None), (7, 7.0, None)]
