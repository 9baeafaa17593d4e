"""Index formula: golden vectors, properties, rounding."""

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from floodlens.functions.risk import RiskParams, with_risk
from floodlens.functions.scalars import clip01, round_exact, signed_label, threshold_class
from floodlens.operators.scoring import (
    LITERAL_READINGS, Scenario, city_gauge, conditions_from_latest, score_zones, simulate, split_scenarios,
)

INPUTS = "rain_mm DOUBLE, tide_m DOUBLE, flow_m3s DOUBLE, elevation_m DOUBLE, slope_class STRING, channel_m DOUBLE, flood_history BOOLEAN"
GOLDEN = [
    ((0.0, 1.8, 100.0, 6.0, "plana", 150.0, True), (0.5296, "alto", 0.0, 0.4375, 1.0, 0.82, 1.0, 0.0)),
    ((0.0, 0.0, 0.0, 20.0, "moderada", 1200.0, False), (0.018, "bajo", 0.0, 0.0, 0.0, 0.09, 0.0, 0.0)),
    ((75.0, 2.0, 42.5, 10.0, "suave", 500.0, False), (0.4935, "medio", 0.5, 0.5, 0.5, 0.53, 0.0, 0.0625)),
    ((150.0, 5.0, 1500.0, 3.0, "plana", 50.0, True), (1.0, "critico", 1.0, 1.0, 1.0, 0.915, 1.0, 0.25)),
    ((150.0, 0.4, 0.0, 10.0, None, 1000.0, False), (0.43, "medio", 1.0, 0.0, 0.0, 0.4, 0.0, 0.0)),
    ((30.0, 3.6, 85.0, 0.0, "plana", 0.0, False), (0.62, "alto", 0.2, 1.0, 1.0, 1.0, 0.0, 0.05)),
]


def risk_rows(spark, rows, params=RiskParams()):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i INT, " + INPUTS)
    cols = ["risk_score", "risk_level", "rain_norm", "tide_norm", "reservoir_norm", "ground_norm", "history_norm",
            "rain_tide_interaction"]
    return [tuple(r[c] for c in cols) for r in with_risk(df, params).orderBy("i").collect()]


def test_golden_vectors(spark):
    assert risk_rows(spark, [g[0] for g in GOLDEN]) == [g[1] for g in GOLDEN]


def test_missing_numbers_never_score(spark):
    base = list(GOLDEN[3][0])
    rows = []
    for i in (0, 1, 2, 3, 5):
        broken = list(base)
        broken[i] = None
        rows.append(tuple(broken))
    for score, level, *_ in risk_rows(spark, rows):
        assert score is None and level is None
    history_unknown = tuple(base[:6] + [None])
    assert risk_rows(spark, [history_unknown])[0][6] == 0.0


def test_bounds_and_monotone(spark):
    rng = random.Random(7)
    zone = lambda: (rng.uniform(-5, 40), rng.choice(["plana", "suave", "moderada", "pronunciada", "x"]), rng.uniform(0, 2000), rng.random() < 0.5)
    rows = []
    for _ in range(300):
        weather, z = [rng.uniform(0, 300), rng.uniform(0, 6), rng.uniform(0, 300)], zone()
        rows.append((*weather, *z))
        for k in range(3):
            more = list(weather)
            more[k] += rng.uniform(0, 50)
            rows.append((*more, *z))
    scores = [r[0] for r in risk_rows(spark, rows)]
    assert all(0.0 <= s <= 1.0 for s in scores)
    for i in range(0, len(scores), 4):
        assert all(scores[i + k] >= scores[i] for k in (1, 2, 3))


def test_level_uses_unrounded_score(spark):
    # 0.35 * (74.99/150) + ... just below a cut still rounds up to it.
    params = RiskParams(digits=1)
    score, level, *_ = risk_rows(spark, [(0.0, 0.4, 0.0, 0.0, "plana", 0.0, False)], params)[0]
    assert (score, level) == (0.2, "bajo")


@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=40))
def _check_round(spark, xs):
    near = [round(x, 4) + d for x in xs for d in (5e-5, -5e-5)]
    values = [float(x) for x in xs + near]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i INT, x DOUBLE")
    got = [r.y for r in df.select("i", round_exact("x", 4).alias("y")).orderBy("i").collect()]
    assert got == [round(x, 4) for x in values]


def test_round_exact_is_script_rounding(spark):
    rng = random.Random(1)
    values = [rng.randrange(0, 100000) / 100000 for _ in range(5000)] + [2.675, 0.28755, 0.5, 1.5, 2.5, -0.125, 0.125]
    for digits in (0, 2, 3, 4):
        df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i INT, x DOUBLE")
        got = [r.y for r in df.select("i", round_exact("x", digits).alias("y")).orderBy("i").collect()]
        assert got == [round(x, digits) for x in values]


def test_round_exact_random(spark):
    _check_round.hypothesis.inner_test(spark, [random.Random(3).uniform(-1e5, 1e5) for _ in range(2000)])


def test_clip_keeps_null(spark):
    rows = spark.createDataFrame([(None,), (-1.0,), (0.3,), (7.0,)], "x DOUBLE").select(clip01("x").alias("y")).collect()
    assert [r.y for r in rows] == [None, 0.0, 0.3, 1.0]


def test_threshold_sides(spark):
    df = spark.createDataFrame([(40.0,), (40.1,), (70.0,), (None,)], "x DOUBLE")
    both = df.select(
        threshold_class("x", (40, 70), "abc").alias("ge"), threshold_class("x", (40, 70), "abc", inclusive=False).alias("gt")
    ).collect()
    assert [tuple(r) for r in both] == [("b", "a"), ("b", "b"), ("c", "b"), (None, None)]
    with pytest.raises(ValueError):
        threshold_class("x", (2, 1), "abc")


def test_signed_label(spark):
    df = spark.createDataFrame([(0.53,), (-0.5,), (0.0,), (0.125,), (1.005,), (None,)], "x DOUBLE")
    assert [r.y for r in df.select(signed_label("x", "°C").alias("y")).collect()] == [
        "+0.53 °C", "-0.50 °C", "0.00 °C", "+0.13 °C", "+1.00 °C", None,
    ]


@pytest.fixture(scope="module")
def zones(spark):
    return spark.createDataFrame(
        [("A", "Alpha", 0.0, 0.0, 6.0, "plana", True, 150.0), ("B", "Beta\n", 1.0, 2.0, 20.0, "moderada", False, 1200.0)],
        "zone_id STRING, sector_name STRING, lat DOUBLE, lon DOUBLE, elevation_m DOUBLE, slope_class STRING, "
        "flood_history BOOLEAN, channel_m DOUBLE",
    )


def test_defaults_are_flagged_and_literal_paths_default(spark, zones):
    latest = spark.createDataFrame(
        [("inocar_mareas", "2024-01-01 00:00:00", '{"altura_marea_m": 2.5}'), ("inamhi", "2024-01-01 00:00:00", "not json")],
        "source STRING, ts STRING, json_str STRING",
    ).selectExpr("source", "CAST(ts AS TIMESTAMP) AS kafka_timestamp", "json_str")
    row = conditions_from_latest(latest).first()
    assert (row.rain_mm, row.tide_m, row.flow_m3s) == (0.0, 2.5, 100.0)
    assert (row.rain_mm_is_default, row.tide_m_is_default, row.flow_m3s_is_default) == (True, False, True)
    assert conditions_from_latest(latest, LITERAL_READINGS).first().tide_m == 1.8


def test_no_readings_at_all_still_scores(spark, zones):
    empty = spark.createDataFrame([], "source STRING, kafka_timestamp TIMESTAMP, json_str STRING")
    rows = {r.zone_id: r for r in score_zones(zones, conditions_from_latest(empty)).collect()}
    assert (rows["A"].risk_score, rows["A"].risk_level) == (0.5296, "alto")
    assert len(rows) == 2


def test_scoring_plan_has_no_join(spark, zones):
    empty = spark.createDataFrame([], "source STRING, kafka_timestamp TIMESTAMP, json_str STRING")
    plan = score_zones(zones, conditions_from_latest(empty))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scenarios(spark, zones):
    rows = simulate(zones, [Scenario("x", 150.0, 5.0, 1500.0), Scenario("y", 0.0, 0.0, 0.0)])
    assert rows.count() == 4
    with pytest.raises(ValueError):
        Scenario("bad", -1.0, 0.0, 0.0)
    with pytest.raises(ValueError):
        Scenario("bad", 0.0, None, 0.0)
    table = spark.createDataFrame([(1.0, 2.0, 3.0), (-1.0, 2.0, 3.0), (None, 0.0, 0.0)], "rain_mm DOUBLE, tide_m DOUBLE, flow_m3s DOUBLE")
    good, bad = split_scenarios(table)
    assert good.count() == 1 and bad.count() == 2


def test_gauge_counts_missing_as_zero(spark):
    df = spark.createDataFrame([("c", 1.0), ("c", None)], "city STRING, risk_score DOUBLE")
    row = city_gauge(df, ["city"]).first()
    assert (row.index_pct, row.n_zones, row.gauge, row.label) == (50.0, 2, "Medio", "c\n50%")
