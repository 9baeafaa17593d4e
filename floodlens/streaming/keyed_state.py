"""Keyed state with stamps and event-time timers: latest values per column, and the bracketing as-of join, on a stream.

Both keep their state in the state store of the query's checkpoint, one small record per key, so a restart goes on where the
stream stopped and a tick costs only the keys that it touches.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from floodlens.session import ship_package

#: State by key needs a store that holds it outside the heap.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_keyed_state(spark: SparkSession) -> None:
    """Let streams that are started from here on keep state by key."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != STATE_STORE:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    ship_package(spark)


class LatestValues(StatefulProcessor):
    """Per key the newest value of every column, each with its stamp; ties go to the greater value."""

    def __init__(self, key: str, columns: Sequence[str], schema: T.StructType, expiry_ms: int | None) -> None:
        self.key, self.columns, self.schema, self.expiry_ms = key, list(columns), schema, expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("latest", self.schema)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = self.state.get() if self.state.exists() else None
        version, timer, *cells = held or (0, None, *[None] * (2 * len(self.columns)))
        changed = held is None
        for row in rows:
            at = row["__at"]
            if at is None:
                continue
            for i, name in enumerate(self.columns):
                value = row[name]
                if value is not None and (cells[2 * i] is None or (at, value) > (cells[2 * i], cells[2 * i + 1])):
                    cells[2 * i:2 * i + 2] = at, value
                    changed = True
        if changed:
            yield self._store(key, version + 1, timer, cells)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if not self.state.exists():
            return
        version, _, *cells = self.state.get()
        watermark = timerValues.getCurrentWatermarkInMs()
        for i in range(len(self.columns)):
            if cells[2 * i] is not None and self._ends(cells[2 * i]) <= watermark:
                cells[2 * i:2 * i + 2] = None, None
        yield self._store(key, version + 1, None, cells)

    def _ends(self, at: int) -> int:
        return at // 1000 + 1 + self.expiry_ms

    def _store(self, key: Any, version: int, timer: int | None, cells: list) -> Row:
        """Keep the record, wake when its first value ends, and hand it on. A record without values still counts its versions."""
        if self.expiry_ms is not None:
            wake = min((self._ends(at) for at in cells[::2] if at is not None), default=None)
            if wake != timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                if wake is not None:
                    self.handle.registerTimer(wake)
                timer = wake
        self.state.update((version, timer, *cells))
        names = [n for c in self.columns for n in (f"{c}__at", c)]
        return Row(**{self.key: key[0], "version": version, **dict(zip(names, cells))})

    def close(self) -> None:
        pass


def latest_values(
    stream: DataFrame, key: str, order_by: str, columns: Sequence[str], expiry: str | None = None, lateness: str = "0 seconds"
) -> DataFrame:
    """The newest non-null value of every column per key, each with its stamp ``<column>__at``, on a stream (update mode).

    A key's record comes out whenever it changes, with a growing ``version``; of a key the greatest version counts. Stamps are
    per column, so rows may arrive in any order: a late row still fills what no newer row has told. Rows without key or stamp
    are dropped. Of values of one instant the greatest counts.

    With ``expiry`` a value is forgotten once the stream's watermark (newest stamp less ``lateness``) has passed its stamp by
    so much, and the record comes out without it; rows behind the watermark are then late for good and dropped.
    """
    use_keyed_state(stream.sparkSession)
    types = {f.name: f.dataType for f in stream.schema.fields}
    cells = [T.StructField(n, t) for c in columns for n, t in ((f"{c}__at", T.LongType()), (c, types[c]))]
    state = T.StructType([T.StructField("version", T.LongType()), T.StructField("timer", T.LongType()), *cells])
    out = T.StructType([T.StructField(key, types[key]), T.StructField("version", T.LongType()), *cells])
    expiry_ms = None if expiry is None else _milliseconds(stream.sparkSession, expiry)
    at = F.unix_micros(F.col(order_by).cast("timestamp"))
    rows = stream.where(F.col(key).isNotNull())
    if expiry is not None:
        rows = rows.withColumn("__ts", F.col(order_by).cast("timestamp")).withWatermark("__ts", lateness)
    rows = rows.select(key, *[c for c in columns if c != key], at.alias("__at"), *(["__ts"] if expiry is not None else []))
    processor = LatestValues(key, columns, state, expiry_ms)
    found = rows.groupBy(key).transformWithState(processor, out, "Update", "None" if expiry is None else "EventTime")
    stamps = {f"{c}__at": F.timestamp_micros(f"{c}__at") for c in columns}
    return found.withColumns(stamps)


def _milliseconds(spark: SparkSession, interval: str) -> int:
    second = spark.range(1).select(F.expr(f"unix_millis(timestamp'1970-01-01 00:00:00Z' + interval {interval})"))
    return second.first()[0]


def newest_versions(records: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """What :func:`latest_values` has told last of each key, of all records that it wrote; keys whose values all ended go."""
    newest = records.groupBy(key).agg(F.max_by(F.struct(*columns), F.col("version")).alias("__row"))
    return newest.select(key, "__row.*").dropna("all", subset=list(columns))


Event = tuple[int, float, float]  # instant, greatest and least height told for it


def settle(events: Sequence[Event], probes: Sequence[tuple], watermark: int, hold: int | None) -> tuple[list[tuple], list[Event], list[tuple]]:
    """Probes whose neighbours are final, and the events and probes to keep.

    ``events`` are sorted by instant, one per instant; a probe's first field is its instant. Nothing up to ``watermark``
    arrives any more. A probe is settled when the first event after it is not beyond the watermark; with ``hold``, events that
    are further than that from it do not count, and it is settled without one when the watermark is. Settled probes come
    with (before, after).
    """
    times = [e[0] for e in events]
    settled, waiting = [], []
    for probe in probes:
        after = bisect_right(times, probe[0])
        before = events[after - 1] if after else None
        end = _end(probe, times, hold)
        if end is None or end > watermark:
            waiting.append(probe)
        else:
            settled.append((probe, before, events[after] if after < len(times) and times[after] == end else None))
    # Later probes lie beyond the watermark; waiting ones have no event between them and it.
    first = min([watermark, *[p[0] for p in waiting]])
    return settled, list(events[max(0, bisect_right(times, first) - 1):]), waiting


def _end(probe: tuple, times: Sequence[int], hold: int | None) -> int | None:
    """When a probe's waiting ends: at the first event after it, or when it has been held; None if neither is known."""
    after = bisect_right(times, probe[0])
    ends = [times[after]] if after < len(times) else []
    return min([*ends, probe[0] + hold] if hold is not None else ends, default=None)


class Bracketing(StatefulProcessor):
    """Holds probes of a key until the event after them is final."""

    def __init__(self, key: str, columns: Sequence[str], state: T.StructType, hold: int | None) -> None:
        self.key, self.columns, self.schema, self.hold = key, list(columns), state, hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("timeline", self.schema)

    def _held(self) -> tuple[int | None, list[Event], list[tuple]]:
        if not self.state.exists():
            return None, [], []
        timer, events, probes = self.state.get()
        return timer, [tuple(e) for e in events], [tuple(p) for p in probes]

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        timer, events, probes = self._held()
        heights = {at: (high, low) for at, high, low in events}
        for row in rows:
            at, height = row["__at"], row["__h"]
            if height is None:
                probes.append((at, *[row[c] for c in self.columns]))
            else:
                high, low = heights.get(at, (height, height))
                heights[at] = max(high, height), min(low, height)
        yield from self._settle(key, timer, sorted((at, *both) for at, both in heights.items()), probes, timerValues)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        _, events, probes = self._held()
        yield from self._settle(key, None, events, probes, timerValues)

    def _settle(self, key: Any, timer: int | None, events: list[Event], probes: list[tuple], timerValues: Any) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        settled, events, probes = settle(events, probes, watermark, self.hold)
        wake = self._wake(events, probes, watermark)
        if wake != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wake is not None:
                self.handle.registerTimer(wake)
        if events or probes:
            self.state.update((wake, events, probes))
        elif self.state.exists():
            self.state.clear()
        for probe, before, after in settled:
            yield Row(**{
                self.key: key[0], "__at": probe[0], **dict(zip(self.columns, probe[1:])),
                "t0": before and before[0], "h0": before and before[1], "t1": after and after[0], "h1": after and after[2]})

    def _wake(self, events: list[Event], probes: list[tuple], watermark: int) -> int | None:
        """When the first probe can be settled; without one, when the last event is final and those before it can go."""
        times = [e[0] for e in events]
        at = [end for p in probes if (end := _end(p, times, self.hold)) is not None]
        if not probes and times and times[-1] > watermark and len(times) > 1:
            at.append(times[-1])
        return -(-min(at) // 1000) if at else None

    def close(self) -> None:
        pass


def bracket_stream(
    readings: DataFrame, key: str, ts: str, value: str, columns: Sequence[str] = (), lateness: str = "2 hours", hold: str | None = None
) -> DataFrame:
    """The last event at or before each probe and the first one after it, on a stream (append mode).

    ``readings`` holds both: rows with a ``value`` are events, rows without are probes, whose ``columns`` come along. A probe
    waits for the watermark (newest instant less ``lateness``) to pass the event after it, when neither neighbour can change
    any more, and comes out once, with ``t0, h0, t1, h1`` as :func:`floodlens.operators.series.bracket` gives them for the
    whole data. Without an event after it a probe waits on; with ``hold`` only events at most so much later count, and it
    comes out without one when that time is over.
    Rows behind the watermark, and rows without key or instant, are dropped.
    """
    use_keyed_state(readings.sparkSession)
    types = {f.name: f.dataType for f in readings.schema.fields}
    own = [T.StructField(c, types[c]) for c in columns]
    event = T.StructType([T.StructField("at", T.LongType()), T.StructField("high", T.DoubleType()), T.StructField("low", T.DoubleType())])
    probe = T.StructType([T.StructField("at", T.LongType()), *own])
    state = T.StructType([T.StructField("timer", T.LongType()), T.StructField("events", T.ArrayType(event)), T.StructField("probes", T.ArrayType(probe))])
    ends = [T.StructField(n, t) for n, t in (("t0", T.LongType()), ("h0", T.DoubleType()), ("t1", T.LongType()), ("h1", T.DoubleType()))]
    out = T.StructType([T.StructField(key, types[key]), T.StructField("__at", T.LongType()), *own, *ends])
    at = F.col(ts).cast("timestamp")
    rows = readings.where(F.col(key).isNotNull() & at.isNotNull()).withColumn("__ts", at).withWatermark("__ts", lateness)
    rows = rows.select(key, "__ts", F.unix_micros("__ts").alias("__at"), F.col(value).cast("double").alias("__h"), *columns)
    hold_us = None if hold is None else 1000 * _milliseconds(readings.sparkSession, hold)
    found = rows.groupBy(key).transformWithState(Bracketing(key, columns, state, hold_us), out, "Append", "EventTime")
    return found.select(key, F.timestamp_micros("__at").alias(ts), *columns, "t0", "h0", "t1", "h1")

