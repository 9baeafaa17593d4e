"""Payload shapes: parallel arrays, maps of maps, wide tables, daily merges, first matches."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodlens.functions.scalars import explode_rows
from floodlens.operators.series import first_of_last_days

MISSING = -999.0  # fixed value: sentinel of absent parameters


def zip_rows(df: DataFrame, driver: str, arrays: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per element of the ``driver`` array with the same position of every other array.

    A short or missing array yields NULLs and sets ``is_ragged``; the payload is never lost.
    """
    length = F.size(driver)
    ragged = F.lit(False)
    for source in arrays.values():
        ragged = ragged | (F.coalesce(F.size(source), F.lit(-1)) != length)

    def row(value: Column, pos: Column) -> Column:
        return F.struct(
            value.alias(driver),
            *[F.get(F.col(source), pos).alias(name) for name, source in arrays.items()],
            ragged.alias("is_ragged"),
        )

    return explode_rows(df, keep, F.transform(driver, row), pos="pos")


def align_params(
    df: DataFrame, driver: str, others: Mapping[str, str], keep: Sequence[str] = (), sentinel: float = MISSING
) -> DataFrame:
    """Rows of the ``driver`` map (date -> value) with the other maps looked up by date.

    A date absent from another map gives ``sentinel``; one that is present with NULL stays NULL.
    Without the driver map there are no rows.
    """

    def looked_up(m: str, key: Column) -> Column:
        present = F.coalesce(F.map_contains_key(F.col(m), key), F.lit(False))
        return F.when(present, F.try_element_at(F.col(m), key)).otherwise(F.lit(sentinel))

    def row(entry: Column) -> Column:
        return F.struct(
            entry["key"].alias("date"), entry["value"].alias(driver),
            *[looked_up(m, entry["key"]).alias(name) for name, m in others.items()],
        )

    return explode_rows(df, keep, F.transform(F.map_entries(driver), row))


def sentinel_to_null(df: DataFrame, columns: Sequence[str], sentinel: float = MISSING) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit(sentinel)) for c in columns})


def nested_regions(regions: Mapping[str, tuple[Column, Column]]) -> Column:
    """Wide columns as one struct of ``region -> (sst, anomaly)``."""
    return F.struct(*[
        F.struct(sst.alias("sst"), anomaly.alias("anomaly")).alias(name) for name, (sst, anomaly) in regions.items()
    ])


def unpivot_regions(df: DataFrame, keep: Sequence[str], regions: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """One row per region from a wide row; a narrow transformation."""
    long = F.array(*[
        F.struct(F.lit(name).alias("region"), sst.alias("sst"), anomaly.alias("anomaly"))
        for name, (sst, anomaly) in regions.items()
    ])
    return explode_rows(df, keep, long)


def first_match_or_head(items: Column | str, matches: Callable[[Column], Column]) -> Column:
    """First element that matches, else the first element, else NULL."""
    items = F.col(items) if isinstance(items, str) else items
    return F.coalesce(F.get(F.filter(items, matches), F.lit(0)), F.get(items, F.lit(0)))


def head_of(items: Column | str) -> Column:
    return F.get(F.col(items) if isinstance(items, str) else items, F.lit(0))


def last_of(items: Column | str) -> Column:
    return F.try_element_at(F.col(items) if isinstance(items, str) else items, F.lit(-1))


def merge_daily(
    base: DataFrame, others: Sequence[tuple[DataFrame, Mapping[str, str]]], base_values: Mapping[str, str],
    date: str = "date", n_days: int = 5, digits: int = 6,
) -> DataFrame:
    """Daily means of several datasets for the newest ``n_days`` days of ``base``.

    The base fixes the days, the others only fill matching ones. The first of those days is a
    scalar subquery, so it bounds every scan before any aggregation; what is joined is at most
    ``n_days`` rows per dataset.
    """

    def means(df: DataFrame, values: Mapping[str, str]) -> DataFrame:
        return df.groupBy(date).agg(*[F.round(F.avg(c), digits).alias(name) for c, name in values.items()])

    first_day = first_of_last_days(base, date, n_days)
    merged = means(base.where(F.col(date) >= first_day), base_values)
    for other, values in others:
        merged = merged.join(means(other.where(F.col(date) >= first_day), values), date, "left")
    return merged


def pair_difference(
    df: DataFrame, station: str, first: str, second: str, value: str, by: Sequence[str]
) -> DataFrame:
    """Mean of one station minus mean of the other per group; groups lacking either are dropped."""
    def mean_of(name: str) -> Column:
        return F.avg(F.when(F.col(station) == name, F.col(value)))

    return (
        df.where(F.col(station).isin(first, second)).groupBy(*by)
        .agg(mean_of(first).alias("first_value"), mean_of(second).alias("second_value"))
        .where(F.col("first_value").isNotNull() & F.col("second_value").isNotNull())
        .withColumn("difference", F.col("first_value") - F.col("second_value"))
    )


def noon_samples(df: DataFrame, ts: str) -> DataFrame:
    """Samples taken at 12:00, labelled by month and day."""
    return df.where(F.date_format(ts, "HH:mm") == "12:00").withColumn("label", F.date_format(ts, "MM-dd"))


def quarter_calendar(df: DataFrame, start_year: int, as_of: Column) -> DataFrame:
    """Every quarter from ``start_year`` up to the one holding ``as_of`` (a column of a one-row frame)."""
    total = (F.year(as_of) - F.lit(start_year)) * 4 + F.quarter(as_of) - 1
    return (
        df.select(F.explode(F.sequence(F.lit(0), total)).alias("__n"))
        .select(
            (F.lit(start_year) + F.floor(F.col("__n") / 4)).cast("int").alias("year"),
            (F.col("__n") % 4 + 1).cast("int").alias("quarter"),
        )
    )
