"""Latest rows and values, partitions, feeds."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from floodlens.functions.risk import LEVELS
from floodlens.operators import latest


def ts(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


@pytest.fixture(scope="module")
def raw(spark):
    rows = [
        ("inocar_mareas", ts(1), "a1"), ("inocar_mareas", ts(3), "a3"), ("inocar_mareas", ts(3), "a4"),
        ("noaa", ts(2), '{"data": [1]}'), ("sngr_alertas", ts(1), "x"), ("sngr_alertas", ts(5), "y"), (None, ts(9), "lost"),
    ]
    df = spark.createDataFrame(rows, "source STRING, kafka_timestamp TIMESTAMP, json_str STRING")
    return df.withColumn("date", F.to_date("kafka_timestamp"))


def test_latest_payload_breaks_ties_and_unwraps(raw):
    got = {r.source: r.json_str for r in latest.latest_payload(raw, ["inocar_mareas", "noaa", "gee"]).collect()}
    assert got == {"inocar_mareas": "a4", "noaa": '{"data": [1]}'}
    assert latest.latest_payload(raw, ["noaa"], unwrap=True).first().json_str == "[1]"
    assert latest.payload_for_file(raw, "noaa_data.json").first().json_str == '{"data": [1]}'
    with pytest.raises(KeyError):
        latest.payload_for_file(raw, "nothing.json")


def test_latest_by_key_without_domain(raw):
    rows = latest.latest_by_key(raw, ["source"], "kafka_timestamp", ["json_str"], ["json_str"]).collect()
    want = {"inocar_mareas": "a4", "noaa": '{"data": [1]}', "sngr_alertas": "y", None: "lost"}
    assert {r.source: r.json_str for r in rows} == want


def test_pruning_on_a_partitioned_table(spark, raw, tmp_path):
    raw.where("source IS NOT NULL").write.partitionBy("source", "date").parquet(str(tmp_path / "raw"))
    table = spark.read.parquet(str(tmp_path / "raw"))
    newest = latest.latest_payload(table, ["inocar_mareas", "noaa"])
    assert newest.count() == 2
    assert "dynamicpruning" in newest._jdf.queryExecution().executedPlan().toString()
    scan = latest.latest_partition(table)
    assert [r.json_str for r in scan.collect()] == ["y"]
    assert "date" not in scan.columns
    assert "PartitionFilters: [isnotnull(date" in scan._jdf.queryExecution().executedPlan().toString()
    ranged = latest.partition_range(table, "date", "2024-01-02", "2024-01-03")
    assert ranged.count() == 3 and latest.partition_range(table).count() == 6
    assert latest.partition_range(table, "date", start="2030-01-01").isEmpty()


def test_nonnull_values_may_mix_snapshots(spark):
    rows = [("Z1", ts(1), 0.4, "medio"), ("Z1", ts(2), None, "alto"), (None, ts(3), 0.9, "alto"), ("Z2", ts(1), None, None)]
    df = spark.createDataFrame(rows, "zone_id STRING, at TIMESTAMP, score DOUBLE, level STRING")
    out = latest.latest_nonnull_by_key(df, "zone_id", "at", ["score", "level"], {"level": LEVELS})
    plan = out._jdf.queryExecution().executedPlan().toString()
    got = {r.zone_id: (r.score, r.level) for r in out.collect()}
    assert got == {"Z1": (0.4, "alto"), "Z2": (None, None)}
    assert plan.count("Exchange") == 1 and "partial_max_by" in plan  # one row per key and task is shipped


def test_latest_risk_keeps_unknown_zones(spark):
    cols = "zone_id STRING, sector_name STRING, lat DOUBLE, lon DOUBLE, rain_mm DOUBLE, tide_m DOUBLE, flow_m3s DOUBLE, risk_score DOUBLE, risk_level STRING, computed_at TIMESTAMP, date DATE"
    day = dt.date(2024, 1, 2)
    snaps = spark.createDataFrame([
        ("A", "old name", 1.0, 1.0, 5.0, 1.0, 1.0, 0.1, "bajo", ts(2), day),
        ("A", "old name", 1.0, 1.0, None, 1.0, 1.0, 0.3, "medio", ts(2, 5), day),
        ("X", "stray", 9.0, 9.0, 5.0, 1.0, 1.0, 0.2, "bajo", ts(2), day),
        ("A", "old name", 1.0, 1.0, 7.0, 1.0, 1.0, 0.9, "critico", ts(1), dt.date(2024, 1, 1)),
    ], cols)
    zones = spark.createDataFrame([("A", "Alpha", 0.5, 0.6)], "zone_id STRING, sector_name STRING, lat DOUBLE, lon DOUBLE")
    got = {r.zone_id: r for r in latest.latest_risk(snaps, zones, {"risk_level": LEVELS}).collect()}
    assert (got["A"].sector_name, got["A"].lat, got["A"].rain_mm, got["A"].risk_score) == ("Alpha", 0.5, 5.0, 0.3)
    assert (got["X"].sector_name, got["X"].lat) == ("stray", 9.0)
    assert got["X"].updated_at == ts(2, 5)


def test_recent_alerts(raw):
    assert [r.json_str for r in latest.recent_alerts(raw, 1).collect()] == ["y"]
    assert latest.recent_alerts(raw, 0).isEmpty()
    assert latest.recent_alerts(raw.where("false")).isEmpty()
    plan = latest.recent_alerts(raw)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    with pytest.raises(ValueError):
        latest.recent_alerts(raw, -1)


def test_zone_filter_reaches_the_scan(spark, tmp_path):
    df = spark.createDataFrame([("Z1", ts(1), 0.5, "alto", 1.0, 2.0, 3.0)], "zone_id STRING, computed_at TIMESTAMP, risk_score DOUBLE, risk_level STRING, rain_mm DOUBLE, tide_m DOUBLE, flow_m3s DOUBLE")
    df.withColumn("date", F.to_date("computed_at")).write.partitionBy("date").parquet(str(tmp_path / "s"))
    rows = latest.zone_history(spark.read.parquet(str(tmp_path / "s")), "Z1", "2024-01-01", "2024-01-01")
    assert rows.count() == 1
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(zone_id,Z1)" in plan and "PartitionFilters: [isnotnull(date" in plan


def test_ties_do_not_depend_on_row_order(spark):
    import itertools

    from floodlens.operators import latest

    rows = [("z", 1, 1, 1.0, "a"), ("z", 1, 2, None, "b"), ("z", 1, 0, 2.0, None), (None, 3, 0, 5.0, "n")]
    for order in itertools.islice(itertools.permutations(rows), 0, 24, 5):
        df = spark.createDataFrame(list(order), "zone STRING, at INT, epoch INT, x DOUBLE, s STRING").coalesce(1)
        by_value = latest.latest_nonnull_by_key(df, "zone", "at", ["x", "s"]).collect()
        assert [tuple(r) for r in by_value] == [("z", 2.0, "b")]
        by_epoch = latest.latest_nonnull_by_key(df, "zone", "at", ["x", "s"], tie_break=["epoch"]).collect()
        assert [tuple(r) for r in by_epoch] == [("z", 1.0, "b")]
        whole = {r.zone: r.x for r in latest.latest_by_key(df, ["zone"], "at", ["epoch"]).collect()}
        assert whole == {"z": None, None: 5.0}


def test_latest_row_is_one_aggregate(spark):
    from floodlens.operators import latest

    df = spark.range(100).selectExpr("id % 7 AS k", "id AS at", "cast(id AS string) AS payload")
    plan = latest.latest_by_key(df, ["k"], "at")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_recent_alerts_read_newest_days_only(spark, raw, tmp_path):
    rows = [("sngr_alertas", dt.datetime(2024, 1, d, h), f"{d}-{h}") for d in range(1, 11) for h in range(3)] + [("noaa", dt.datetime(2024, 2, 1), "n")]
    df = spark.createDataFrame(rows, "source STRING, kafka_timestamp TIMESTAMP, json_str STRING").withColumn("date", F.to_date("kafka_timestamp"))
    df.write.partitionBy("source", "date").parquet(str(tmp_path / "a"))
    table = spark.read.parquet(str(tmp_path / "a"))
    for n in (1, 3, 4, 7, 100):
        want = [r[2] for r in sorted(rows[:30], key=lambda r: r[1], reverse=True)[:n]]
        assert [r.json_str for r in latest.recent_alerts(table, n).collect()] == want
    plan = latest.recent_alerts(table, 4)._jdf.queryExecution().executedPlan().toString()
    assert "isnotnull(date" in plan and "date#" in plan.split("PartitionFilters")[1]
