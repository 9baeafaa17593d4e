"""Streams: restarts, retries, batch equality."""

import datetime as dt

from pyspark.sql import functions as F

from floodlens.plans import views as v
from floodlens.sources.sinks import land_raw
from floodlens.sources.topics import to_raw
from floodlens.sources.zones import write_zones
from floodlens.streaming.landing import MonitorConfig, land_and_score, run_monitor
from floodlens.streaming.windows import drop_retries, rain_24h


def test_landing_restart_adds_nothing(spark, sf, tmp_path):
    def land():
        stream = to_raw(v.topic_records(v.event_stream(spark, sf)))
        land_raw(stream, str(tmp_path / "raw"), str(tmp_path / "ck"), once=True).awaitTermination()
        return spark.read.parquet(str(tmp_path / "raw")).count()

    first = land()
    assert first == v.table(spark, sf, "events").count() and land() == first


def monitor(spark, sf, tmp_path):
    base = str(tmp_path / "m")
    records = v.topic_records(v.table(spark, sf, "events"))
    records.repartition(3, "key").write.mode("overwrite").parquet(f"{base}/topics")
    write_zones(v.zones(spark, sf), f"{base}/zones")
    return MonitorConfig(base=base, zones_path=f"{base}/zones", topic_files=f"{base}/topics", max_files_per_trigger=1, as_of="2024-02-01 00:00:00")


def test_monitor_scores_each_tick_and_survives_a_repeat(spark, sf, tmp_path):
    config = monitor(spark, sf, tmp_path)
    run_monitor(spark, config)
    run_monitor(spark, config)  # same checkpoint, nothing new
    snaps = spark.read.parquet(config.snapshots)
    n_zones = v.zones(spark, sf).count()
    per_epoch = {r.epoch_id: r["count"] for r in snaps.groupBy("epoch_id").count().collect()}
    assert per_epoch == {0: n_zones, 1: n_zones, 2: n_zones}
    raw_before = spark.read.parquet(config.raw).count()
    assert raw_before == v.table(spark, sf, "events").count()
    # The last epoch again, as after a failure before its commit.
    batch = spark.read.parquet(config.raw).where("epoch_id = 2").drop("epoch_id").select("json_str", "kafka_timestamp", "source", "date").checkpoint()
    land_and_score(batch, 2, v.zones(spark, sf), config, snaps.first().run_id)
    assert spark.read.parquet(config.raw).count() == raw_before
    again = {r.epoch_id: r["count"] for r in spark.read.parquet(config.snapshots).groupBy("epoch_id").count().collect()}
    assert again == per_epoch


def test_retries_are_dropped(spark, tmp_path):
    rows = [("s", i % 5, dt.datetime(2024, 1, 1, 0, i)) for i in range(10)]
    spark.createDataFrame(rows, "source STRING, event_id INT, ts TIMESTAMP").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source STRING, event_id INT, ts TIMESTAMP").parquet(str(tmp_path / "in"))
    query = drop_retries(stream, ["source", "event_id"], "ts").writeStream.format("memory").queryName("once").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.awaitTermination()
    assert spark.table("once").count() == 5


def test_rain_stream_equals_batch_for_closed_windows(spark, sf, tmp_path):
    def readings(df):
        return df.where("event_type = 'purchase'").select(F.col("user_id").alias("station"), F.col("ts").cast("timestamp").alias("ts"), "value")

    batch = {(r.station, r.window_start): round(r.rain_24h_mm, 6) for r in rain_24h(readings(v.table(spark, sf, "events")), "station", "ts", "value").collect()}
    query = rain_24h(readings(v.event_stream(spark, sf)), "station", "ts", "value").writeStream.format("memory").queryName("rain").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.awaitTermination()
    got = {(r.station, r.window_start): round(r.rain_24h_mm, 6) for r in spark.table("rain").collect()}
    assert got and all(batch[k] == x for k, x in got.items())


def test_a_new_checkpoint_replaces_nothing(spark, sf, tmp_path):
    """Epochs count from 0 again; rows, snapshots and readings of the earlier run stay."""
    import dataclasses
    import json

    base = tmp_path / "n"
    zones = v.zones(spark, sf)
    write_zones(zones, f"{base}/zones")

    def land(folder, minute, topic, payload):
        rows = [(topic, "k", json.dumps(payload), dt.datetime(2024, 1, 1, 0, minute))]
        spark.createDataFrame(rows, "topic STRING, key STRING, value STRING, timestamp TIMESTAMP").write.parquet(f"{base}/{folder}")
        return MonitorConfig(base=str(base), zones_path=f"{base}/zones", topic_files=f"{base}/{folder}", as_of="2024-02-01 00:00:00")

    @dataclasses.dataclass(frozen=True)
    class Anew(MonitorConfig):
        @property
        def checkpoint(self):
            return f"{self.base}/_checkpoints/anew"

    run_monitor(spark, land("t1", 1, "mareas-inocar", {"altura_marea_m": 3.3}))
    run_monitor(spark, Anew(**dataclasses.asdict(land("t2", 2, "nivel-embalse-celec", {"nivel_msnm": 77.0})) | {"readings": MonitorConfig("", "").readings, "params": MonitorConfig("", "").params}))
    assert spark.read.parquet(f"{base}/raw").count() == 2
    snaps = spark.read.parquet(f"{base}/snapshots")
    assert snaps.count() == 2 * zones.count() and snaps.select("run_id").distinct().count() == 2
    assert {(r.tide_m, r.flow_m3s) for r in snaps.select("tide_m", "flow_m3s").distinct().collect()} >= {(3.3, 77.0)}
