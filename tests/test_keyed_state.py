"""Keyed state, timers and the stream join: equal to the batch operators, with late rows and restarts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from floodlens.operators.latest import latest_nonnull_by_key
from floodlens.operators.series import bracket
from floodlens.streaming.joins import join_within
from floodlens.streaming.keyed_state import bracket_stream, latest_values, newest_versions, settle
from floodlens.streaming.windows import upsert_by_epoch

START = dt.datetime(2024, 1, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


class Feed:
    """Files that a stream reads one by one, in the order they were added."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema = spark, str(path), schema

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.path)


def run(df, base, mode="append"):
    """To the end of what there is, on the checkpoint of the runs before."""
    writer = df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ck").outputMode(mode)
    writer.trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.parquet(f"{base}/out")


VALUES = "zone string, ts timestamp, x double, s string"


def test_latest_values_equal_the_batch_across_restarts(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", "c", None]), at(rng.randrange(3000)), rng.choice([None, rng.random()]), rng.choice([None, "p", "q"])) for _ in range(240)]
    rows += [("t", at(5), 1.0, "b"), ("t", at(5), 2.0, "a"), ("n", None, 9.0, "z"), ("n", at(1), None, None)]
    feed = Feed(spark, tmp_path / "in", VALUES)
    for part in (0, 1):
        feed.add(rows[part::4])
        feed.add(rows[part + 2::4])
        upsert_by_epoch(latest_values(feed.stream(), "zone", "ts", ["x", "s"]), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    records = spark.read.parquet(f"{tmp_path}/out")
    have = sorted(map(tuple, newest_versions(records, "zone", ["x", "s"]).collect()))
    stamped = spark.createDataFrame([r for r in rows if r[1] is not None], VALUES)
    want = latest_nonnull_by_key(stamped, "zone", "ts", ["x", "s"]).dropna("all", subset=["x", "s"])
    assert have == sorted(map(tuple, want.collect())) and ("t", 2.0, "b") in have
    # A row that is late in time fills a column that no newer row has told, and moves nothing else.
    feed.add([("late", at(900), None, "new"), ("late", at(1), 7.0, "old")])
    upsert_by_epoch(latest_values(feed.stream(), "zone", "ts", ["x", "s"]), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    late = newest_versions(spark.read.parquet(f"{tmp_path}/out"), "zone", ["x", "s", "x__at", "s__at"]).where("zone = 'late'").first()
    assert (late.x, late.s, late.x__at, late.s__at) == (7.0, "new", at(1), at(900))


def test_values_expire(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", VALUES)
    for rows in ([("a", at(0), 1.0, None), ("b", at(0), 1.0, "k")], [("a", at(90), None, "p"), ("c", at(300), 3.0, "r")], [("c", at(301), 4.0, None)]):
        feed.add(rows)
        stream = latest_values(feed.stream(), "zone", "ts", ["x", "s"], expiry="2 hours", lateness="60 minutes")
        upsert_by_epoch(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    # The watermark is at minute 241: what was told before minute 121 is forgotten, except that 'a' and 'b' come out without it.
    records = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, newest_versions(records, "zone", ["x", "s"]).collect())) == [("c", 4.0, "r")]
    last = {r.zone: (r.x, r.s) for r in records.orderBy("version").collect()}
    assert last["a"] == (None, None) and last["b"] == (None, None)


READINGS = "station string, ts timestamp, height_m double, probe_id long"


def readings(rng, n, stations=3, minutes=2000):
    return [(f"s{rng.randrange(stations)}", at(rng.randrange(minutes)), None if rng.random() < 0.5 else round(rng.random(), 3), i) for i in range(n)]


def split(spark, rows):
    df = spark.createDataFrame(rows, READINGS)
    return df.where("height_m is null").drop("height_m"), df.where("height_m is not null").select("station", "ts", "height_m")


def test_bracket_stream_equals_the_batch(spark, tmp_path):
    """Rows up to the allowed lateness out of order, in many ticks and two runs."""
    rows = readings(random.Random(5), 400)
    rows += [("s0", at(700), 0.9, 900), ("s0", at(700), 0.1, 901), ("s0", at(700), None, 902), ("quiet", at(3), None, 903), (None, at(3), 1.0, 904), ("s1", None, 1.0, 905)]
    arrival = sorted(rows, key=lambda r: (r[1] or START) + dt.timedelta(minutes=random.Random(r[3]).randrange(110)))
    feed = Feed(spark, tmp_path / "in", READINGS)
    for half in (arrival[:200], arrival[200:]):
        for k in range(0, len(half), 70):
            feed.add(half[k:k + 70])
        out = run(bracket_stream(feed.stream(), "station", "ts", "height_m", ["probe_id"]), tmp_path)
    probes, events = split(spark, [r for r in rows if r[0] is not None and r[1] is not None])
    newest = max(r[1] for r in rows if r[1] is not None)
    closed = int((newest - dt.timedelta(hours=2) - START).total_seconds() * 1e6) + int(START.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)
    want = bracket(probes, events, "station").where(F.col("t1") <= closed).select("station", "ts", "probe_id", "t0", "h0", "t1", "h1")
    have = sorted(map(tuple, out.collect()), key=repr)
    assert have == sorted(map(tuple, want.collect()), key=repr) and len(have) > 150


def test_rows_behind_the_watermark_are_dropped_and_probes_held_no_longer(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", READINGS)
    make = lambda: bracket_stream(feed.stream(), "station", "ts", "height_m", ["probe_id"], lateness="10 minutes", hold="1 hour")
    feed.add([("s", at(0), 1.0, 0), ("s", at(10), None, 1), ("lone", at(5), None, 2), ("other", at(500), None, 3)])
    run(make(), tmp_path)
    feed.add([("s", at(20), 2.0, 4), ("s", at(495), 5.0, 5), ("s", at(12), None, 6), ("s", at(496), None, 7), ("s", at(640), 3.0, 8)])
    run(make(), tmp_path)
    out = {r.probe_id: (r.h0, r.h1) for r in run(make(), tmp_path).collect()}
    # 1 waited for an hour and came out without the event at minute 20, which with probe 6 arrived behind the watermark of minute 490.
    assert out == {1: (1.0, None), 2: (None, None), 3: (None, None), 7: (5.0, None)}  # 7: the event at 640 is too late


def test_settle_against_brute_force():
    rng = random.Random(11)
    for _ in range(200):
        events = sorted({t: (t, h, h - 0.5) for t, h in ((rng.randrange(100), rng.random()) for _ in range(rng.randrange(12)))}.values())
        probes = [(rng.randrange(100), i) for i in range(rng.randrange(8))]
        watermark, hold = rng.randrange(110), rng.choice([None, 10, 50])
        settled, kept, waiting = settle(events, probes, watermark, hold)
        done = {p: (b, a) for p, b, a in settled}
        for p in probes:
            before = max((e for e in events if e[0] <= p[0]), default=None)
            after = min((e for e in events if p[0] < e[0] and (hold is None or e[0] <= p[0] + hold)), default=None)
            if after is not None and after[0] <= watermark:
                assert done[p] == (before, after)
            elif hold is not None and p[0] + hold <= watermark:
                assert done[p] == (before, None)
            else:
                assert p in waiting and p not in done
                assert max((e for e in kept if e[0] <= p[0]), default=None) == before
                assert after is None or min(e for e in kept if e[0] > p[0]) == after
        later = watermark + 1  # what a probe to come needs is kept too
        assert max((e for e in kept if e[0] <= later), default=None) == max((e for e in events if e[0] <= later), default=None)


SIDE = "station string, ts timestamp, reading double"


def test_stream_join_equals_the_batch(spark, tmp_path):
    rng = random.Random(8)
    ours, theirs = ([(rng.choice(["a", "b", None]), at(rng.randrange(1500)), float(i)) for i in range(150)] for _ in range(2))
    left, right = (Feed(spark, tmp_path / n, SIDE) for n in ("left", "right"))
    parts = [lambda r, k=k: r[1] >= at(500 * k) and r[1] < at(500 * k + 500) for k in range(3)]
    for inside in parts:  # a restart after each third
        left.add([r for r in ours if inside(r)])
        right.add([r for r in theirs if inside(r)])
        joined = join_within(left.stream(), right.stream().withColumnRenamed("reading", "other"), "station", lateness="30 minutes", columns=["other"])
        out = run(joined, tmp_path)
    batch = join_within(spark.createDataFrame(ours, SIDE), spark.createDataFrame(theirs, SIDE).withColumnRenamed("reading", "other"), "station", columns=["other"])
    plain = sorted(((s, t, x, u if m else None, y if m else None) for s, t, x in ours if s for u, y, m in (
        [(u, y, True) for z, u, y in theirs if z == s and abs(u - t) <= dt.timedelta(hours=1)] or [(None, None, False)])), key=repr)
    assert sorted(map(tuple, batch.collect()), key=repr) == plain
    closed = at(1500 - 30 - 60 - 60)
    assert sorted((tuple(r) for r in out.collect() if r.ts < closed), key=repr) == [r for r in plain if r[1] < closed]
    # A row behind the watermark is dropped: no partner is looked for, and it does not come out alone.
    before = out.count()
    left.add([("a", at(3), 999.0)])
    joined = join_within(left.stream(), right.stream().withColumnRenamed("reading", "other"), "station", lateness="30 minutes", columns=["other"])
    after = run(joined, tmp_path)
    assert after.count() == before and after.where("reading = 999").isEmpty()


def test_join_within_of_two_tables(spark):
    ours = spark.createDataFrame([("a", at(0), 1.0), ("a", at(200), 2.0), (None, at(0), 3.0)], SIDE)
    theirs = spark.createDataFrame([("a", at(60), 5.0), ("a", at(61), 6.0), ("b", at(0), 7.0)], SIDE).withColumnRenamed("reading", "other")
    rows = join_within(ours, theirs, "station", columns=["other"]).collect()
    assert sorted((r.reading, r.other or 0.0) for r in rows) == [(1.0, 5.0), (2.0, 0.0)]
    assert join_within(ours, theirs, "station", how="inner", columns=["other"]).count() == 1
    with pytest.raises(ValueError):
        join_within(ours, theirs, "station", how="full")
