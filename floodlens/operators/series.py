"""Time-series operators: carry-forward, bracketing as-of, interpolation, fallback."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodlens.functions.scalars import round_exact
from floodlens.functions.tide_model import (
    DEFAULT_MODEL, FALLING, ORIGIN_MODEL, ORIGIN_TABLE, RISING, TideModel, with_harmonic_tide,
)
# Slots are gathered into spans of this many, so that no window holds all slots of a long-lived key.
SLOTS_PER_SPAN = 1_000


def _hand_over(per_slot: DataFrame, keys: Sequence[str], columns: Mapping[str, bool]) -> DataFrame:
    """``keys, __slot`` and, per column, the value that the nearest other slot of the key hands over.

    A column marked True is handed from later slots to earlier ones. ``per_slot`` has one row per
    key and slot. Slots are carried within their span, spans along the key: a window never holds
    more than ``SLOTS_PER_SPAN`` slots, nor more spans than the key's whole time has.
    """
    others = (Window.unboundedPreceding, -1)
    per_slot = per_slot.withColumn("__span", F.floor(F.col("__slot") / SLOTS_PER_SPAN))

    def carried(name: str, later: bool, groups: Sequence[str], by: str) -> Column:
        order = F.col(by).desc() if later else F.col(by)
        return F.last(name, ignorenulls=True).over(Window.partitionBy(*groups).orderBy(order).rowsBetween(*others))

    inside = per_slot.select(
        *keys, "__span", "__slot", *[carried(c, later, [*keys, "__span"], "__slot").alias(c) for c, later in columns.items()]
    )
    known = {c: F.when(F.col(c).isNotNull(), F.col("__slot")) for c in columns}
    spans = per_slot.groupBy(*keys, "__span").agg(
        *[(F.min_by if later else F.max_by)(c, known[c]).alias(c) for c, later in columns.items()]
    )
    spans = spans.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__span").alias("__s"),
        *[carried(c, later, keys, "__span").alias(f"__span_{c}") for c, later in columns.items()],
    )
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)] + [F.col("__span") == F.col("__s")]
    return inside.join(spans, on).select(*keys, "__slot", *[F.coalesce(c, f"__span_{c}").alias(c) for c in columns])


def carry_forward(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], column: str, slot: Column, into: str
) -> DataFrame:
    """Last known value of ``column`` at or before each row of the same key, as column ``into``.

    ``slot`` is a whole number that grows with ``order_by`` (a time or line bucket). Rows alike in
    key and order are reduced to one first, the greatest value counting, so a hot instant is one row
    of its window; the running window covers one key and slot, and what enters a slot from earlier
    ones comes from a summary of one row per key and slot. The rows take part in one equi-join.
    """
    at = [*keys, *order_by]
    instants = df.groupBy(*at, slot.cast("long").alias("__slot")).agg(F.max(column).alias("__value"))
    order = [F.col(c) for c in order_by]
    running = (
        Window.partitionBy(*keys, "__slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = instants.withColumn("__local", F.last("__value", ignorenulls=True).over(running))
    position = F.when(F.col("__value").isNotNull(), F.struct(*order))
    per_slot = instants.groupBy(*keys, "__slot").agg(F.max_by("__value", position).alias("__entering"))
    entering = _hand_over(per_slot, keys, {"__entering": False}).select(
        *[F.col(k).alias(f"__e{i}") for i, k in enumerate(keys)], F.col("__slot").alias("__es"), "__entering"
    )
    on = [F.col(k).eqNullSafe(F.col(f"__e{i}")) for i, k in enumerate(keys)] + [F.col("__slot").eqNullSafe(F.col("__es"))]
    filled = local.join(entering, on, "left").select(
        *[F.col(c).alias(f"__a{i}") for i, c in enumerate(at)], F.coalesce("__local", "__entering").alias("__filled")
    )
    same = [F.col(c).eqNullSafe(F.col(f"__a{i}")) for i, c in enumerate(at)]
    kept = [c for c in df.columns if c != into]
    return df.join(filled, same, "left").select(*kept, F.col("__filled").alias(into))


def bracket(
    probes: DataFrame, events: DataFrame, key: str, ts: str = "ts", value: str = "height_m", slot_hours: float = 1.0
) -> DataFrame:
    """Attach the last event at or before each probe and the first one after it.

    Adds ``t0, h0, t1, h1`` (instants in epoch microseconds), NULL where a side is missing. Of
    several events at one instant the greatest value counts as the last and the least as the first.

    Only distinct instants of probes and events meet in the windows (copies collapse map-side), one
    key and time slot at a time; a summary per slot hands the neighbouring events over. The full
    probe rows take part in a single equi-join at the end, which adaptive execution can split when
    one instant is hot. No row ever meets more than its own two neighbours.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    slot = F.floor(F.col("__at") / F.lit(int(slot_hours * 3_600_000_000)))
    instants = probes.select(F.col(key).alias("__key"), at.alias("__at"))
    seen = events.select(F.col(key).alias("__key"), at.alias("__at"), F.col(value).cast("double").alias("__h")).where(
        F.col("__key").isNotNull() & F.col("__at").isNotNull() & F.col("__h").isNotNull()
    )
    known = seen.groupBy("__key", "__at").agg(F.max("__h").alias("__high"), F.min("__h").alias("__low"))
    nothing = F.lit(None).cast("double")
    timeline = (
        instants.distinct().select("__key", "__at", F.lit(1).alias("__probe"), nothing.alias("__high"), nothing.alias("__low"))
        .unionByName(known.select("__key", "__at", F.lit(0).alias("__probe"), "__high", "__low"))
        .withColumn("__slot", slot)
    )

    here = Window.partitionBy("__key", "__slot")
    upto = (Window.unboundedPreceding, Window.currentRow)
    is_event = F.col("__probe") == 0
    before = F.when(is_event, F.struct("__at", F.col("__high").alias("__h")))
    after = F.when(is_event, F.struct("__at", F.col("__low").alias("__h")))
    local = timeline.select(
        "__key", "__at", "__slot", "__probe",
        F.last(before, ignorenulls=True)
        .over(here.orderBy("__at", "__probe").rowsBetween(*upto)).alias("__before"),
        F.last(after, ignorenulls=True)
        .over(here.orderBy(F.col("__at").desc(), F.col("__probe").desc()).rowsBetween(*upto)).alias("__after"),
    ).where("__probe = 1")

    # One row per key and slot: what it hands to its neighbours.
    event_at = F.when(is_event, F.col("__at"))
    ends = timeline.groupBy("__key", "__slot").agg(
        F.max(event_at).alias("__t_last"),
        F.max_by("__high", event_at).alias("__h_last"),
        F.min(event_at).alias("__t_first"),
        F.min_by("__low", event_at).alias("__h_first"),
    )

    def pair(t: str, h: str) -> Column:
        return F.when(F.col(t).isNotNull(), F.struct(F.col(t).alias("__at"), F.col(h).alias("__h")))

    per_slot = ends.select(
        "__key", "__slot", pair("__t_last", "__h_last").alias("__left"), pair("__t_first", "__h_first").alias("__right")
    )
    handed = _hand_over(per_slot, ["__key"], {"__left": False, "__right": True}).select(
        F.col("__key").alias("__k"), F.col("__slot").alias("__s"), "__left", "__right"
    )
    found = (
        local.join(handed, (F.col("__key") == F.col("__k")) & (F.col("__slot") == F.col("__s")), "left")
        .withColumn("__before", F.coalesce("__before", "__left"))
        .withColumn("__after", F.coalesce("__after", "__right"))
        .select(
            F.col("__key").alias("__bk"), F.col("__at").alias("__bt"),
            F.col("__before.__at").alias("t0"), F.col("__before.__h").alias("h0"),
            F.col("__after.__at").alias("t1"), F.col("__after.__h").alias("h1"),
        )
    )
    return (
        probes.withColumn("__pt", at)
        .join(found, (F.col(key) == F.col("__bk")) & (F.col("__pt") == F.col("__bt")), "left")
        .drop("__pt", "__bk", "__bt")
    )


def interpolate(bracketed: DataFrame, ts: str = "ts", high_margin_m: float = 0.3, digits: int = 3) -> DataFrame:
    """Linear height between the bracketing events, its trend and the high-tide flag.

    All three are NULL unless the probe has an event on both sides.
    """
    now = F.unix_micros(F.col(ts).cast("timestamp"))
    span = F.col("t1") - F.col("t0")
    usable = F.col("t0").isNotNull() & F.col("t1").isNotNull() & (span > 0)
    share = (now - F.col("t0")) / span
    exact = bracketed.withColumn("__height", F.when(usable, F.col("h0") + (F.col("h1") - F.col("h0")) * share))
    trend = F.when(F.col("h1") > F.col("h0"), F.lit(RISING)).otherwise(F.lit(FALLING))
    high = F.col("__height") >= F.greatest("h0", "h1") - F.lit(high_margin_m)
    return exact.select(
        *bracketed.columns,
        round_exact("__height", digits).alias("height_m"),
        F.when(usable, trend).alias("trend"),
        F.when(usable, high).alias("high_tide"),
    )


def tide_with_fallback(bracketed: DataFrame, ts: str = "ts", model: TideModel = DEFAULT_MODEL) -> DataFrame:
    """Interpolated tide where bracketed, harmonic model elsewhere, with the origin named."""
    both = with_harmonic_tide(interpolate(bracketed, ts), ts, "__model", model)
    measured = F.col("height_m").isNotNull()
    rest = [c for c in bracketed.columns if c not in ("t0", "h0", "t1", "h1")]
    return both.select(
        *rest,
        *[F.coalesce(c, f"__model.{c}").alias(c) for c in ("height_m", "trend", "high_tide")],
        F.when(measured, ORIGIN_TABLE).otherwise(ORIGIN_MODEL).alias("origin"),
    )


def first_of_last_days(df: DataFrame, date: str = "date", n: int = 5) -> Column:
    """Oldest of the ``n`` newest distinct dates, as a scalar that can bound any scan."""
    newest = df.select(date).distinct().orderBy(F.col(date).desc()).limit(n)
    return newest.agg(F.min(date)).scalar()


def last_days(df: DataFrame, date: str = "date", n: int = 5) -> DataFrame:
    """Rows of the ``n`` newest distinct dates: one pruning filter, no join."""
    return df.where(F.col(date) >= first_of_last_days(df, date, n))
