"""Time series: as-of, interpolation, harmonic model, fills, printed tables, calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from floodlens.functions import scalars as sc
from floodlens.functions.tide_model import with_harmonic_tide
from floodlens.operators import payloads, series
from floodlens.plans import views as v
from floodlens.plans.registry import query
from floodlens.sources import normalizers
from floodlens.sources import text_tables as tt

TIDE_SQL = """
    known AS (SELECT user_id AS station, ts, max(value / 100e0) AS hi, min(value / 100e0) AS lo
              FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY 1, 2),
    probes AS (SELECT event_id, user_id AS station, ts FROM events WHERE event_type NOT IN ('purchase', 'signup')),
    before AS (SELECT p.event_id, p.station, p.ts, k.ts AS t0, k.hi AS h0
               FROM probes p ASOF LEFT JOIN known k ON p.station = k.station AND p.ts >= k.ts),
    bracketed AS (SELECT b.*, k.ts AS t1, k.lo AS h1
                  FROM before b ASOF LEFT JOIN known k ON b.station = k.station AND b.ts < k.ts),
    interp AS (SELECT *, CASE WHEN t0 IS NOT NULL AND t1 IS NOT NULL THEN
                 h0 + (h1 - h0) * ((epoch_us(ts) - epoch_us(t0)) / (epoch_us(t1) - epoch_us(t0))) END AS h FROM bracketed)"""
_MODEL = "(1.8e0 + 1.4e0 * sin(2e0 * pi() * ({h}) / 12.42e0) + 0.4e0 * sin(2e0 * pi() * ({h}) / 12e0))"
_NOW, _LATER = (_MODEL.format(h=h) for h in ("epoch_us(ts) / 3.6e9", "epoch_us(ts) / 3.6e9 + 1e0"))


@query("tide_interpolate", f"""WITH {TIDE_SQL}
    SELECT event_id, station, ts, t0, t1, CAST(printf('%.3f', h) AS DOUBLE) AS height_m,
           CASE WHEN h IS NOT NULL THEN CASE WHEN h1 > h0 THEN 'subiendo' ELSE 'bajando' END END AS trend,
           CASE WHEN h IS NOT NULL THEN h >= greatest(h0, h1) - 0.3e0 END AS high_tide
    FROM interp""")
def tide_interpolate(spark, sf):
    probes, known = v.tide_series(spark, sf)
    rows = series.interpolate(series.bracket(probes, known, "station"))
    at = lambda c: v.ntz(F.timestamp_micros(c)).alias(c)
    return rows.select("event_id", "station", "ts", at("t0"), at("t1"), "height_m", "trend", "high_tide")


@query("tide_with_fallback", f"""WITH {TIDE_SQL}
    SELECT event_id, station, ts, CAST(printf('%.3f', coalesce(h, {_NOW})) AS DOUBLE) AS height_m,
           CASE WHEN h IS NOT NULL THEN CASE WHEN h1 > h0 THEN 'subiendo' ELSE 'bajando' END
                WHEN {_LATER} > {_NOW} THEN 'subiendo' ELSE 'bajando' END AS trend,
           CASE WHEN h IS NOT NULL THEN h >= greatest(h0, h1) - 0.3e0 ELSE {_NOW} >= 2.8e0 END AS high_tide,
           CASE WHEN h IS NOT NULL THEN 'INOCAR_pdf' ELSE 'modelo_armonico_fallback' END AS origin
    FROM interp""")
def tide_with_fallback(spark, sf):
    probes, known = v.tide_series(spark, sf)
    return series.tide_with_fallback(series.bracket(probes, known, "station"))


@query("harmonic_tide", f"""
    SELECT event_id, CAST(printf('%.3f', {_NOW}) AS DOUBLE) AS height_m, CASE WHEN {_LATER} > {_NOW} THEN 'subiendo' ELSE 'bajando' END AS trend,
           {_NOW} >= 2.8e0 AS high_tide FROM events""")
def harmonic(spark, sf):
    return with_harmonic_tide(v.table(spark, sf, "events").select("event_id", "ts"), "ts", "m").select("event_id", "m.*")


@query("forward_fill", """
    SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS)
             OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS filled
    FROM events""")
def forward_fill(spark, sf):
    rows = v.table(spark, sf, "events").select(
        "event_id", "user_id", "ts", F.when(F.col("event_type") == "purchase", F.col("value")).alias("reading")
    )
    filled = series.carry_forward(
        rows, ["user_id"], ["ts", "event_id"], "reading", F.unix_date(F.to_date("ts")), "filled"
    )
    return filled.select("event_id", "user_id", "filled")


def tide_documents(spark, sf):
    """A small printed table per event: headings, a dated line with a group too many, weekday lines with one cut short,
    unreadable groups."""
    e = v.table(spark, sf, "events")
    hhmm = F.date_format("ts", "HHmm")
    quarter = (F.col("event_id") % 4 + 1).cast("int")

    def height(c: int):
        return (F.col("value") + c).cast("decimal(12,2)").cast("string")

    dated = [
        F.concat_ws(" ", (F.pmod(F.col("event_id") + c * 7, F.lit(31)) + 1).cast("string"), hhmm, height(c))
        for c in range(7)
    ]
    weekday = [F.concat_ws(" ", F.lit("LU"), hhmm, height(c)) for c in range(3)]
    first_month = F.get(F.array(*map(F.lit, tt.MONTHS)), (quarter - 1) * 3)
    lines = [
        F.lit("TABLA DE MAREAS"), first_month, F.lit("HORA ALTURA"),
        F.concat_ws("  ", *dated), F.concat_ws(" ", *weekday, F.lit("MI 1200")), F.lit(""),
        F.lit("XX 1200 1.00 MA 0630 0.55 SA 12a0 0.7"), F.lit("* nota"),
    ]
    return e.select(
        F.col("event_id").alias("doc"), F.lit(2024).alias("year"), quarter.alias("quarter"),
        F.concat_ws("\n", *lines).alias("text"),
    )


@query("tide_table_parse", """
    WITH cells AS (
      SELECT event_id, event_id % 4 + 1 AS quarter, 3 AS line_no, c AS col, strftime(ts, '%H:%M') AS hm, value + c AS h
      FROM events, (SELECT unnest(range(6)) AS c)
      UNION ALL
      SELECT event_id, event_id % 4 + 1, 4, c, strftime(ts, '%H:%M'), value + c FROM events, (SELECT unnest(range(3)) AS c)
      UNION ALL
      SELECT event_id, event_id % 4 + 1, 6, 1, '06:30', 0.55e0 FROM events),
    dated AS (
      SELECT *, (event_id + col * 7) % 31 + 1 AS day, (quarter - 1) * 3 + col // 2 + 1 AS month FROM cells)
    SELECT event_id AS doc, line_no, col::INTEGER AS "column", event_ts, round(CAST(h AS DECIMAL(12,2))::DOUBLE, 3) AS height_m
    FROM (SELECT *, try_cast('2024-' || lpad(month::VARCHAR, 2, '0') || '-' || lpad(day::VARCHAR, 2, '0') || ' ' || hm || ':00' AS TIMESTAMP) AS event_ts FROM dated)
    WHERE event_ts IS NOT NULL""")
def tide_table_parse(spark, sf):
    events = tt.tide_events(tt.parse_tide_tables(tide_documents(spark, sf)))
    return events.select("doc", "line_no", "column", v.ntz("event_ts").alias("event_ts"), "height_m")


@query("tide_history", """
    WITH cells AS (
      SELECT event_id, event_id % 4 + 1 AS quarter, c AS col FROM events, (SELECT unnest(range(6)) AS c)
      UNION ALL SELECT event_id, event_id % 4 + 1, c FROM events, (SELECT unnest(range(3)) AS c)
      UNION ALL SELECT event_id, event_id % 4 + 1, 1 FROM events),
    dated AS (SELECT *, (event_id + col * 7) % 31 + 1 AS day, (quarter - 1) * 3 + col // 2 + 1 AS month FROM cells)
    SELECT 2024 AS year, quarter::INTEGER AS quarter, count(*) AS n_events, 'INOCAR_pdf' AS origin FROM dated
    WHERE quarter <= 3 AND try_cast('2024-' || lpad(month::VARCHAR, 2, '0') || '-' || lpad(day::VARCHAR, 2, '0') AS DATE) IS NOT NULL
    GROUP BY 2""")
def tide_history(spark, sf):
    """All quarters up to the one of a given day."""
    rows = tt.tide_events(tt.tide_history(tide_documents(spark, sf), 2022, F.lit("2024-08-15").cast("date")))
    return rows.groupBy("year", "quarter", "origin").agg(F.count(F.lit(1)).alias("n_events"))


@query("tide_table_rejects", """
    WITH cells AS (
      SELECT event_id, event_id % 4 + 1 AS quarter, 3 AS line_no, c AS col FROM events, (SELECT unnest(range(6)) AS c)
      UNION ALL SELECT event_id, event_id % 4 + 1, 4, c FROM events, (SELECT unnest(range(3)) AS c)
      UNION ALL SELECT event_id, event_id % 4 + 1, 6, 1 FROM events),
    dated AS (SELECT *, (event_id + col * 7) % 31 + 1 AS day, (quarter - 1) * 3 + col // 2 + 1 AS month FROM cells)
    SELECT 'bad_date' AS problem, count(*) AS n_groups FROM dated
    WHERE try_cast('2024-' || lpad(month::VARCHAR, 2, '0') || '-' || lpad(day::VARCHAR, 2, '0') AS DATE) IS NULL
    UNION ALL SELECT 'bad_time', count(*) FROM events
    UNION ALL SELECT 'bad_layout', 2 * count(*) FROM events""")
def tide_table_rejects(spark, sf):
    rejects = tt.tide_rejects(tt.parse_tide_tables(tide_documents(spark, sf)))
    return rejects.groupBy("problem").agg(F.count(F.lit(1)).alias("n_groups"))


@query("normalize_tide", f"""
    WITH cells AS (
      SELECT event_id, event_id % 4 + 1 AS quarter, c AS col, strftime(ts, '%H:%M') AS hm, value + c AS h FROM events, (SELECT unnest(range(6)) AS c)
      UNION ALL SELECT event_id, event_id % 4 + 1, c, strftime(ts, '%H:%M'), value + c FROM events, (SELECT unnest(range(3)) AS c)
      UNION ALL SELECT event_id, event_id % 4 + 1, 1, '06:30', 0.55e0 FROM events),
    printed AS (
      SELECT 1 AS port, try_cast('2024-' || lpad(((quarter - 1) * 3 + col // 2 + 1)::VARCHAR, 2, '0') || '-' || lpad(((event_id + col * 7) % 31 + 1)::VARCHAR, 2, '0')
             || ' ' || hm || ':00' AS TIMESTAMP) AS ts, round(CAST(h AS DECIMAL(12,2))::DOUBLE, 3) AS h FROM cells),
    known AS (SELECT port, ts, max(h) AS hi, min(h) AS lo FROM printed WHERE ts IS NOT NULL GROUP BY 1, 2),
    probes AS (SELECT event_id, 1 AS port, TIMESTAMP '2023-12-25 00:00:00' + to_minutes((event_id * 37 % 560000)::BIGINT) AS ts FROM events),
    before AS (SELECT p.*, k.ts AS t0, k.hi AS h0 FROM probes p ASOF LEFT JOIN known k ON p.port = k.port AND p.ts >= k.ts),
    around AS (SELECT b.*, k.ts AS t1, k.lo AS h1 FROM before b ASOF LEFT JOIN known k ON b.port = k.port AND b.ts < k.ts),
    interp AS (SELECT *, CASE WHEN t0 IS NOT NULL AND t1 IS NOT NULL THEN
                 h0 + (h1 - h0) * ((epoch_us(ts) - epoch_us(t0)) / (epoch_us(t1) - epoch_us(t0))) END AS h FROM around)
    SELECT event_id, CASE WHEN h IS NOT NULL THEN 'INOCAR_pdf' ELSE 'modelo_armonico_fallback' END AS fuente, 'Guayaquil' AS puerto,
           CAST(printf('%.3f', coalesce(h, {_NOW})) AS DOUBLE) AS altura_marea_m,
           CASE WHEN h IS NOT NULL THEN CASE WHEN h1 > h0 THEN 'subiendo' ELSE 'bajando' END
                WHEN {_LATER} > {_NOW} THEN 'subiendo' ELSE 'bajando' END AS tendencia,
           CASE WHEN h IS NOT NULL THEN h >= greatest(h0, h1) - 0.3e0 ELSE {_NOW} >= 2.8e0 END AS pleamar
    FROM interp""")
def normalize_tide(spark, sf):
    """Printed tables and probe instants in, published records out; some instants lie outside the tables."""
    minutes = F.col("event_id") * 37 % 560_000
    start = F.lit("2023-12-25 00:00:00").cast("timestamp")
    probes = v.table(spark, sf, "events").select(
        "event_id", F.timestamp_micros(F.unix_micros(start) + minutes * 60_000_000).alias("ts"))
    return normalizers.tide_records(tide_documents(spark, sf), probes).drop("ts")


@query("quarter_calendar", """
    WITH days AS (SELECT year(o_orderdate) AS y, quarter(o_orderdate) AS q, count(*) AS n, max(o_orderdate) AS last FROM orders GROUP BY 1, 2),
    ends AS (SELECT year(max(o_orderdate)) * 4 + quarter(max(o_orderdate)) - 1 AS stop FROM orders),
    cal AS (SELECT (k // 4)::INTEGER AS year, (k % 4 + 1)::INTEGER AS quarter
            FROM (SELECT unnest(range(1994 * 4, (SELECT stop FROM ends) + 1)) AS k))
    SELECT cal.year, cal.quarter, coalesce(n, 0) AS n_orders, strftime(last - INTERVAL 2 DAY, '%Y-%m-%d') AS two_days_before
    FROM cal LEFT JOIN days ON days.y = cal.year AND days.q = cal.quarter""")
def quarter_calendar(spark, sf):
    orders = v.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d"))
    per_quarter = orders.groupBy(F.year("d").alias("year"), sc.quarter_of("d").alias("quarter")).agg(
        F.count(F.lit(1)).alias("n"), F.max("d").alias("last")
    )
    calendar = payloads.quarter_calendar(orders.agg(F.max("d").alias("d")), 1994, F.col("d"))
    return calendar.join(per_quarter, ["year", "quarter"], "left").select(
        "year", "quarter", F.coalesce("n", F.lit(0)).alias("n_orders"),
        sc.shift_day("last", -2).alias("two_days_before"),
    )


@query("epoch_dates", """
    SELECT event_id, strftime(make_timestamp(epoch_ms(ts) * 1000), '%Y-%m-%d') AS ms_date,
           strftime(make_timestamp(epoch_us(ts)), '%Y-%m-%d') AS ns_date FROM events""")
def epoch_dates(spark, sf):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = v.table(spark, sf, "events").select(
        "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), (us * 1000 + 999).alias("ns")
    )
    return rows.select(
        "event_id", sc.epoch_millis_date("ms").alias("ms_date"), sc.epoch_nanos_date("ns").alias("ns_date")
    )
