"""Join of two streams of readings, each side's state bounded by the watermarks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _seconds(interval: str) -> Column:
    return F.expr(f"unix_seconds(timestamp'1970-01-01 00:00:00Z' + interval {interval})")


def join_within(
    left: DataFrame, right: DataFrame, key: str, ts: str = "ts", within: str = "1 hour", lateness: str = "2 hours", how: str = "left",
    columns: Sequence[str] = (),
) -> DataFrame:
    """Rows of ``left`` with all rows of ``right`` of the same key at most ``within`` before or after, on two streams or two tables.

    The key carries a time slot of width ``within``: a left row lies in one slot, a right row is offered to the three around
    its own, so a row meets the rows of its time only, not all that the state holds of a busy key, and a busy key is dealt over
    its slots. Both sides forget a row once the watermarks (newest instant of a side less ``lateness``, the lesser of the two)
    are past every partner that it could still have. With ``how="left"`` a left row without partner comes out then, once.

    Rows behind the watermark are dropped, rows without key or instant too. Adds ``right_ts`` and the right's ``columns``.
    """
    if how not in ("left", "inner"):
        raise ValueError("rows of the left side come with or without partners")
    span = _seconds(within)
    at = F.unix_micros(F.col(ts).cast("timestamp"))

    def slot(instant: Column) -> Column:
        return F.floor(instant / (span * 1_000_000))

    ours = left.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    ours = ours.withColumn("__slot", slot(at)).alias("ours")
    theirs = right.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(key).alias("__key"), F.col(ts).cast("timestamp").alias("right_ts"), *columns).withWatermark("right_ts", lateness)
    own = slot(F.unix_micros("right_ts"))
    theirs = theirs.withColumn("__offered", F.explode(F.sequence(own - 1, own + 1))).alias("theirs")
    near = F.expr(f"right_ts >= `{ts}` - interval {within} and right_ts <= `{ts}` + interval {within}")
    joined = ours.join(theirs, (F.col(key) == F.col("__key")) & (F.col("__slot") == F.col("__offered")) & near, "leftOuter" if how == "left" else "inner")
    return joined.drop("__slot", "__key", "__offered")
