"""Latest rows, latest values, partition scans, histories and feeds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodlens.functions.scalars import unwrap_data
from floodlens.schemas import FILE_SOURCES


# Keys that may be named one by one; the tables made of them are broadcast.
MOST_KEY_VALUES = 10_000


def _newest_days(df: DataFrame, key: str, day: str) -> DataFrame:
    """Rows of each key's newest day.

    On a table partitioned by key and day the first pass reads partition values only, and the small
    broadcast of newest days prunes the partitions of the scan at run time, so a source that fell
    silent long ago does not widen the scan of the others.
    """
    days = df.groupBy(key).agg(F.max(day).alias("__day")).select(F.col(key).alias("__key"), "__day")
    return df.join(F.broadcast(days), (F.col(key) == F.col("__key")) & (F.col(day) == F.col("__day"))).drop(
        "__key", "__day"
    )


def latest_by_key(
    df: DataFrame,
    keys: Sequence[str],
    order_by: str,
    tie_break: Sequence[str] = (),
    columns: Sequence[str] | None = None,
    key_values: Sequence | None = None,
    day: str | None = None,
) -> DataFrame:
    """One whole row per key: greatest ``order_by``, then greatest ``tie_break``.

    In general this is one aggregate: every task ships one row per key it has seen, a NULL key
    being a key like any other. Rows whose ``order_by`` is NULL count only if ``tie_break`` tells.

    ``key_values`` names the possible values of a single key (for instance the configured sources),
    whose payloads may be wide; rows of other keys, NULL included, are left out. Then pass one reads the key and order columns only; its buffers are fixed-width, so it stays a hash
    aggregate with map-side combine however large one key is. Pass two keeps the rows at the newest
    instant: the oldest of the per-key maxima is pushed into the scan as a row-group filter, and
    the wide payload columns are never sorted or shuffled before that filter.

    The maxima, which cannot outgrow the list, are broadcast. ``day`` names a date column derived
    from ``order_by``; it narrows the work to each key's newest day first.
    """
    columns = [c for c in (columns or df.columns) if c not in keys]
    rank = F.struct(*[F.col(c) for c in (order_by, *tie_break)])
    winner = F.max_by(F.struct(*columns), rank).alias("__row")
    if key_values is None:
        return df.groupBy(*keys).agg(winner).select(*keys, "__row.*")
    if len(key_values) > MOST_KEY_VALUES:
        raise ValueError(f"more than {MOST_KEY_VALUES} key values are not a list to broadcast")
    df = df.where(F.col(keys[0]).isin(list(key_values)))
    if day is not None:
        df = _newest_days(df, keys[0], day)
    newest = df.groupBy(*keys).agg(F.max(order_by).alias("__newest"))
    floor = newest.agg(F.min("__newest")).scalar()
    renamed = F.broadcast(newest.select(*[F.col(k).alias(f"__{k}") for k in keys], "__newest"))
    on = [F.col(k) == F.col(f"__{k}") for k in keys] + [F.col(order_by) == F.col("__newest")]
    at_newest = df.where(F.col(order_by) >= floor).join(renamed, on)
    return at_newest.groupBy(*keys).agg(winner).select(*keys, "__row.*")


def latest_nonnull_by_key(
    df: DataFrame,
    key: str,
    order_by: str,
    columns: Sequence[str],
    domains: Mapping[str, Sequence[str]] | None = None,
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Latest value per column, skipping NULLs column by column; rows without a key are dropped.

    Of values of one instant the greatest by ``tie_break`` counts, then the greatest. A result row may therefore mix several snapshots. Columns with a small ``domain`` of texts are
    carried as their position in it, which keeps what a task ships small.
    """
    domains = dict(domains or {})
    aggs: list[Column] = []
    for name in columns:
        value = F.col(name)
        if name in domains:
            value = F.nullif(F.array_position(F.array(*map(F.lit, domains[name])), value), F.lit(0))
        seen_at = F.when(F.col(name).isNotNull(), F.struct(order_by, *tie_break, value))
        aggs.append(F.max_by(value, seen_at).alias(name))
    grouped = df.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs)
    decoded = [
        F.get(F.array(*map(F.lit, domains[c])), F.col(c).cast("int") - 1).alias(c) if c in domains else F.col(c)
        for c in columns
    ]
    return grouped.select(key, *decoded)


def latest_partition(df: DataFrame, partition: str = "date", drop: bool = True) -> DataFrame:
    """Rows of the newest partition; the maximum reaches the scan as a partition filter."""
    newest = df.agg(F.max(partition)).scalar()
    rows = df.where(F.col(partition) == newest)
    return rows.drop(partition) if drop else rows


def partition_range(df: DataFrame, partition: str = "date", start=None, end=None) -> DataFrame:
    """Rows of the closed partition range; either bound may be missing."""
    if start is not None:
        df = df.where(F.col(partition) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(partition) <= F.lit(end).cast("date"))
    return df


def latest_payload(raw: DataFrame, sources: Sequence[str], unwrap: bool = False) -> DataFrame:
    """Newest record of each source's newest instant, for the named sources."""
    rows = latest_by_key(
        raw, ["source"], "kafka_timestamp", ["json_str"], ["kafka_timestamp", "json_str"], key_values=sources,
        day="date" if "date" in raw.columns else None,
    )
    return rows.withColumn("json_str", unwrap_data("json_str")) if unwrap else rows


def payload_for_file(raw: DataFrame, filename: str) -> DataFrame:
    """Newest payload behind a logical file name; layers come without their envelope."""
    if filename not in FILE_SOURCES:
        raise KeyError(filename)
    return latest_payload(raw, [FILE_SOURCES[filename]], unwrap=filename.endswith(".geojson"))


def latest_risk(snapshots: DataFrame, zones: DataFrame, domains: Mapping[str, Sequence[str]]) -> DataFrame:
    """Newest known values per zone of the newest partition, with the zone table's names and places.

    Zones missing from the zone table keep the values of their snapshot.
    """
    newest = latest_partition(snapshots, "date")
    measures = [
        "sector_name", "lat", "lon", "rain_mm", "tide_m", "flow_m3s", "risk_score", "risk_level", "computed_at",
    ]
    values = latest_nonnull_by_key(newest, "zone_id", "computed_at", measures, domains)
    stamp = newest.agg(F.max("computed_at")).scalar()
    dim = zones.select(
        F.col("zone_id").alias("__zone"), F.col("sector_name").alias("__name"),
        F.col("lat").alias("__lat"), F.col("lon").alias("__lon"),
    )
    return values.join(dim, F.col("zone_id") == F.col("__zone"), "left").select(
        "zone_id",
        F.coalesce("__name", "sector_name").alias("sector_name"),
        F.coalesce("__lat", "lat").alias("lat"),
        F.coalesce("__lon", "lon").alias("lon"),
        *measures[3:],
        stamp.alias("updated_at"),
    )


HISTORY_COLUMNS = ("computed_at", "risk_score", "risk_level", "rain_mm", "tide_m", "flow_m3s")


def zone_history(snapshots: DataFrame, zone_id: str | None = None, start=None, end=None) -> DataFrame:
    """Snapshots of one zone in time order, or of all zones in no order: sorting them all is for who reads them."""
    rows = partition_range(snapshots, "date", start, end)
    if zone_id is not None:
        return rows.where(F.col("zone_id") == zone_id).select(*HISTORY_COLUMNS).orderBy("computed_at")
    return rows.select("zone_id", *HISTORY_COLUMNS)


def history_series(history: DataFrame) -> DataFrame:
    """Chart series: index in percent with the two overlays, missing values as zero."""
    zero = F.lit(0.0)
    keep = ["zone_id"] if "zone_id" in history.columns else []
    return history.select(
        *keep,
        "computed_at",
        (F.coalesce("risk_score", zero) * 100).alias("index_pct"),
        F.coalesce("tide_m", zero).alias("tide_m"),
        F.coalesce("rain_mm", zero).alias("rain_mm"),
    )


def recent(df: DataFrame, order_by: str, tie_break: Sequence[str] = (), n: int = 20) -> DataFrame:
    """The newest ``n`` rows, newest first (a top-k: no full sort)."""
    if n < 0:
        raise ValueError("n must not be negative")
    return df.orderBy(F.col(order_by).desc(), *[F.col(c).desc() for c in tie_break]).limit(n)


def newest_days_with(df: DataFrame, n: int, day: str = "date") -> DataFrame:
    """Rows of the newest days that together hold at least ``n`` rows.

    Days are counted by their partition values; the payload is read for the days that remain only.
    """
    counts = df.groupBy(day).agg(F.count(F.lit(1)).alias("__n"))
    newer = Window.orderBy(F.col(day).desc()).rowsBetween(Window.unboundedPreceding, -1)  # one row per day
    wanted = counts.withColumn("__newer", F.coalesce(F.sum("__n").over(newer), F.lit(0))).where(F.col("__newer") < n)
    return df.where(F.col(day) >= wanted.agg(F.min(day)).scalar())


def recent_alerts(raw: DataFrame, n: int = 20) -> DataFrame:
    """The newest alerts; a table with a ``date`` column is read from its newest date back."""
    alerts = raw.where(F.col("source") == "sngr_alertas")
    if "date" in raw.columns and n > 0:
        alerts = newest_days_with(alerts, n)
    return recent(alerts.select("json_str", "kafka_timestamp"), "kafka_timestamp", ["json_str"], n)


def source_status(raw: DataFrame, sources: Sequence[str]) -> DataFrame:
    """``source, is_empty, n_records, n_days, newest_day`` of every named source, those without a record too.

    On a table partitioned by source and date the counts come from partition values and file footers.
    """
    named = raw.sparkSession.createDataFrame([(s,) for s in sources], "source STRING")
    counts = raw.groupBy("source", "date").agg(F.count(F.lit(1)).alias("n"))
    held = counts.groupBy("source").agg(F.sum("n").alias("n_records"), F.count(F.lit(1)).alias("n_days"), F.max("date").alias("newest_day"))
    n = F.coalesce("n_records", F.lit(0))
    return named.join(held, "source", "left").select(
        "source", (n == 0).alias("is_empty"), n.alias("n_records"), F.coalesce("n_days", F.lit(0)).alias("n_days"), "newest_day")
