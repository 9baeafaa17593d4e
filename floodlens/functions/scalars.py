"""Small scalar rules: clipping, threshold classes, JSON scalars, labels, dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip01(x: ColumnLike) -> Column:
    """Clamp to [0, 1]. The guard keeps NULL as NULL: ``least``/``greatest`` skip NULLs."""
    x = as_col(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def round_exact(x: ColumnLike, digits: int, ties: str = "even") -> Column:
    """Round the exact binary value of a double, as scripting languages do.

    Spark's ``round`` works on the shortest decimal text, so 0.28755 (in binary a little below that
    text) goes up; here it goes down. The product ``x * 10**digits`` is kept without error as a
    double plus its remainder; only a true tie goes to the even neighbour (or ``ties="away"``).
    """
    x = as_col(x).cast("double")
    scale = F.lit(float(10**digits))
    wide = x * F.lit(134217729.0)  # 2**27 + 1 splits a double into two halves
    high = wide - (wide - x)
    product = x * scale
    error = (high * scale - product) + (x - high) * scale
    whole = F.floor(product).cast("double")
    beyond = (product - whole - F.lit(0.5)) + error
    tie_up = F.pmod(whole, F.lit(2.0)) != 0 if ties == "even" else product > 0
    up = (beyond > 0) | ((beyond == 0) & tie_up)
    return (whole + F.when(up, F.lit(1.0)).otherwise(F.lit(0.0))) / scale


def threshold_class(
    x: ColumnLike, cuts: Sequence[float], labels: Sequence[str], inclusive: bool = True
) -> Column:
    """Label ``x`` by ascending ``cuts``; ``len(labels) == len(cuts) + 1``.

    ``inclusive`` puts a value equal to a cut in the upper class (>=), otherwise in the lower (>).
    NULL stays NULL.
    """
    if len(labels) != len(cuts) + 1 or list(cuts) != sorted(cuts):
        raise ValueError("cuts must ascend and labels must be one longer than cuts")
    x = as_col(x)
    expr = F.when(x.isNull(), F.lit(None).cast("string"))
    for cut, label in zip(cuts, labels):
        below = x < F.lit(float(cut)) if inclusive else x <= F.lit(float(cut))
        expr = expr.when(below, F.lit(label))
    return expr.otherwise(F.lit(labels[-1]))


def json_double(json: ColumnLike, paths: Sequence[str]) -> Column:
    """First path that holds a number; NULL when none does or the text is not JSON."""
    json = as_col(json)
    found = [F.get_json_object(json, p).try_cast("double") for p in paths]
    return F.coalesce(*found) if len(found) > 1 else found[0]


def json_double_or(json: ColumnLike, paths: Sequence[str], default: float) -> Column:
    return F.coalesce(json_double(json, paths), F.lit(float(default)))


def unwrap_data(json: ColumnLike) -> Column:
    """The ``data`` member of an envelope, or the whole document when there is none."""
    json = as_col(json)
    return F.coalesce(F.get_json_object(json, "$.data"), json)


def falsy_to(x: ColumnLike, default: str) -> Column:
    """Text default that also replaces the empty string."""
    return F.coalesce(F.nullif(as_col(x), F.lit("")), F.lit(default))


def number_or_zero(x: ColumnLike) -> Column:
    return F.coalesce(as_col(x).cast("double"), F.lit(0.0))


def parse_flag(text: ColumnLike) -> Column:
    """True only for the text ``true`` in any case."""
    return F.lower(as_col(text)) == F.lit("true")


def signed_label(x: ColumnLike, unit: str, digits: int = 2) -> Column:
    """``+0.53 °C``: a plus sign only above zero."""
    x = as_col(x)
    sign = F.when(x > 0, F.lit("+")).otherwise(F.lit(""))
    text = F.format_string(f"%.{digits}f", round_exact(x, digits, ties="away"))
    return F.when(x.isNotNull(), F.concat(sign, text, F.lit(f" {unit}")))


def percent_label(name: ColumnLike, index100: ColumnLike) -> Column:
    """Name, line break, rounded percent."""
    whole = F.floor(as_col(index100) + F.lit(0.5)).cast("string")
    return F.concat(as_col(name), F.lit("\n"), whole, F.lit("%"))


def gauge_class(index100: ColumnLike) -> Column:
    """City gauge on 0-100; the bounds themselves belong to the lower class."""
    return threshold_class(index100, (40.0, 70.0), ("Bajo", "Medio", "Alto"), inclusive=False)


def anomaly_class4(x: ColumnLike) -> Column:
    return threshold_class(x, (-0.5, 0.5, 1.5), ("cool", "neutral", "warm", "hot"))


def anomaly_class5(x: ColumnLike) -> Column:
    return threshold_class(x, (-1.5, -0.5, 0.5, 1.5), ("cold", "cool", "neutral", "warm", "hot"))


def uv_class(x: ColumnLike) -> Column:
    return threshold_class(x, (5.0, 8.0), ("low", "moderate", "high"))


def tide_alert(height_m: ColumnLike) -> Column:
    return number_or_zero(height_m) > F.lit(2.5)


def reservoir_alert(level_m: ColumnLike) -> Column:
    return number_or_zero(level_m) > F.lit(80.0)


def elevation_risk(elevation_m: ColumnLike) -> Column:
    """Ground below sea level counts as zero."""
    ground = F.when(as_col(elevation_m).isNotNull(), F.greatest(F.lit(0.0), as_col(elevation_m)))
    return threshold_class(ground, (2.0, 5.0), ("Alto / Crítico", "Medio", "Bajo"))


def evacuation_offered(elevation_m: ColumnLike) -> Column:
    return F.greatest(F.lit(0.0), as_col(elevation_m)) < F.lit(5.0)


# Texts of the pressure-index phases.
PHASE_WARM = "Fase El Niño (Acoplamiento Atmosférico)"
PHASE_COLD = "Fase La Niña"
PHASE_NEUTRAL = "Fase Neutra"


def pressure_phase(difference: ColumnLike) -> Column:
    """Phase of the pressure difference; both bounds are strict."""
    d = as_col(difference)
    return (
        F.when(d.isNull(), F.lit(None).cast("string"))
        .when(d < -1.0, F.lit(PHASE_WARM))
        .when(d > 1.0, F.lit(PHASE_COLD))
        .otherwise(F.lit(PHASE_NEUTRAL))
    )


def epoch_millis_date(ms: ColumnLike) -> Column:
    return F.date_format(F.timestamp_millis(as_col(ms)), "yyyy-MM-dd")


def epoch_nanos_date(ns: ColumnLike) -> Column:
    """Whole-number division keeps 19-digit nanoseconds exact (a double would not)."""
    ns = as_col(ns)
    micros = (ns - F.pmod(ns, F.lit(1000))) / F.lit(1000)
    return F.date_format(F.timestamp_micros(micros.cast("long")), "yyyy-MM-dd")


def quarter_of(d: ColumnLike) -> Column:
    return F.quarter(as_col(d))


def shift_day(d: ColumnLike, days: ColumnLike | int) -> Column:
    """Date moved by whole days, as ``yyyy-MM-dd``."""
    return F.date_format(F.date_add(as_col(d), F.lit(days) if isinstance(days, int) else as_col(days)), "yyyy-MM-dd")


def iso_utc(ts: ColumnLike) -> Column:
    """ISO-8601 stamp with microseconds and zone, as the envelopes carry it."""
    return F.date_format(as_col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def explode_rows(df: DataFrame, keep: Sequence[str], rows: Column, pos: str | None = None) -> DataFrame:
    """One row per struct of an array, with its position on request; empty arrays give no rows.

    A plain ``explode`` of a computed array makes the optimizer test its size in a filter below,
    which evaluates the array (a JSON parse, say) twice. The outer variant with a test on the
    position does not.
    """
    exploded = df.select(*keep, F.posexplode_outer(rows).alias("__pos", "__row"))
    shown = [F.col("__pos").alias(pos)] if pos else []
    return exploded.where(F.col("__pos").isNotNull()).select(*keep, *shown, "__row.*")


def pin(df: DataFrame, keep: Sequence[str], **computed: Column) -> DataFrame:
    """Compute expensive columns once.

    A filter above a projection is pushed below it together with copies of every expression it
    mentions. A one-element generator is a fence for that: filters on the pinned columns stay above
    it, those on the kept columns still reach the scan.
    """
    row = F.struct(*[c.alias(name) for name, c in computed.items()])
    return df.select(*keep, F.explode_outer(F.array(row)).alias("__pin")).select(*keep, "__pin.*")
