"""Text tables: blank-delimited index tables and printed tide tables."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floodlens.functions.scalars import explode_rows, pin, round_exact
from floodlens.functions.text import strip_blanks
from floodlens.functions.tide_model import ORIGIN_TABLE

# Columns of the monthly ocean-index table, after numbering repeated headings.
OCEAN_TABLE_COLUMNS = (
    "YR", "MON", "NINO1+2", "ANOM", "NINO3", "ANOM.1", "NINO4", "ANOM.2", "NINO3.4", "ANOM.3",
)

# Month names in calendar order, weekday codes and heading words of the tide table.
MONTHS = (
    "ENERO", "FEBRERO", "MARZO", "ABRIL", "MAYO", "JUNIO",
    "JULIO", "AGOSTO", "SEPTIEMBRE", "OCTUBRE", "NOVIEMBRE", "DICIEMBRE",
)
WEEKDAYS = ("LU", "MA", "MI", "JU", "VI", "SA", "DO")
HEADINGS = ("TABLA", "GUAYAQUIL", "HORA", "*")
SUB_COLUMNS = 6  # three months side by side, two sub-columns each
ASCII_BLANKS = r"[ \t\n\x0B\f\r]+"


def number_repeats(names: Sequence[str]) -> list[str]:
    """Repeated headings get ``.1``, ``.2``, … in order of appearance."""
    seen: Counter[str] = Counter()
    out = []
    for name in names:
        out.append(f"{name}.{seen[name]}" if seen[name] else name)
        seen[name] += 1
    return out


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Documents (one row per file) with their path; a document's lines stay together."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("doc"), F.col("value").alias("text")
    )


def document_lines(documents: DataFrame, text: str = "text", keep: Sequence[str] = ("doc",)) -> DataFrame:
    """Non-empty trimmed lines with their number within the document."""
    lines = documents.select(*keep, F.posexplode_outer(F.split(text, r"\r\n|\r|\n")).alias("line_no", "__line"))
    return pin(lines, [*keep, "line_no"], line=strip_blanks("__line")).where(F.col("line") != "")


def parse_blank_table(
    lines: DataFrame, columns: Sequence[str], line: str = "line", keep: Sequence[str] = (), header: str | None = None
) -> DataFrame:
    """Cells split at runs of blanks, by position, as doubles; the heading row is dropped.

    ``header`` is the first heading. Column names with dots or plus signs are legal but need
    back-quotes in later expressions.
    """
    cells = F.split(strip_blanks(line), r"\s+")
    head = header if header is not None else columns[0]
    rows = pin(lines, keep, __cells=cells).where(F.get("__cells", F.lit(0)) != head)
    return rows.select(
        *keep, *[F.get("__cells", F.lit(i)).try_cast("double").alias(name) for i, name in enumerate(columns)]
    )


def month_number(name: Column | str) -> Column:
    """1-12, or NULL for an unknown name."""
    name = F.col(name) if isinstance(name, str) else name
    return F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.upper(name)), F.lit(0)).cast("int")


def column_month(quarter: Column | str, column: Column | str) -> Column:
    """Month number printed above a sub-column of a quarter's table."""
    quarter = F.col(quarter) if isinstance(quarter, str) else quarter
    column = F.col(column) if isinstance(column, str) else column
    return ((quarter - 1) * 3 + F.floor(column / 2) + 1).cast("int")


def _table_lines(text: Column, quarter: Column) -> Column:
    """``line_no, tokens`` of the lines that hold groups; lines of headings and of the quarter's month names do not."""
    months = F.array(*[F.array(*map(F.lit, MONTHS[q:q + 3])) for q in range(0, len(MONTHS), 3)])
    named = F.coalesce(F.get(months, quarter.cast("int") - 1), F.array().cast("array<string>"))
    numbered = F.transform(F.split(text, r"\r\n|\r|\n"), lambda line, i: F.struct(i.alias("line_no"), strip_blanks(line).alias("line")))

    def holds_groups(row: Column) -> Column:
        line, heading = row["line"], F.lit(False)
        for word in HEADINGS:
            heading = heading | F.startswith(line, F.lit(word))
        return (line != "") & ~heading & ~F.array_contains(named, line)

    return F.transform(F.filter(numbered, holds_groups), lambda row: F.struct(row["line_no"].alias("line_no"), F.split(row["line"], ASCII_BLANKS).alias("tokens")))


def _is_number(mark: Column) -> Column:
    return F.coalesce(mark.rlike(r"\A[0-9]+\z"), F.lit(False))


def _days_after(lines: Column) -> Column:
    """The day of each sub-column before the first line and after every line: a fold whose state is the last of them."""
    none = F.array_repeat(F.lit(None).cast("int"), SUB_COLUMNS)
    columns = F.sequence(F.lit(0), F.lit(SUB_COLUMNS - 1))

    def next_line(days: Column, line: Column) -> Column:
        def day(column: Column) -> Column:
            mark, height = F.get(line["tokens"], column * 3), F.get(line["tokens"], column * 3 + 2)
            return F.when(_is_number(mark) & height.isNotNull(), mark.try_cast("int")).otherwise(F.get(F.element_at(days, -1), column))

        return F.concat(days, F.array(F.transform(columns, day)))

    return F.aggregate(lines, F.array(none), next_line)


def _groups(lines: Column, days: Column) -> Column:
    """``line_no, column, day, hhmm, height`` of every group, in order; no day where it cannot be laid out."""
    weekdays = F.array(*map(F.lit, WEEKDAYS))

    def of_line(line: Column, i: Column) -> Column:
        def group(column: Column) -> Column:
            mark, hhmm, height = (F.get(line["tokens"], column * 3 + k) for k in range(3))
            laid_out = (column < SUB_COLUMNS) & height.isNotNull()
            return F.struct(
                line["line_no"].alias("line_no"), column.alias("column"), F.when(laid_out, F.get(F.get(days, i + 1), column)).alias("day"),
                hhmm.alias("hhmm"), height.alias("height"), (_is_number(mark) | F.array_contains(weekdays, mark)).alias("marked"))

        last = F.ceil(F.size(line["tokens"]) / 3).cast("int") - 1
        return F.filter(F.transform(F.sequence(F.lit(0), last), group), lambda g: g["marked"])

    return F.flatten(F.transform(lines, of_line))


def parse_tide_tables(
    documents: DataFrame, doc: Sequence[str] = ("doc",), year: str = "year", quarter: str = "quarter", text: str = "text"
) -> DataFrame:
    """Printed tide tables into ``event_ts, height_m`` with a ``problem`` for groups that do not parse.

    A line holds up to six groups ``<day or weekday> <HHMM> <height>``. A number starts a day in its
    sub-column; a weekday code belongs to the last day seen there. Groups with another mark are text
    and skipped; a group of a line's seventh and later sub-columns, one that is cut short, and a
    weekday code before any day are set aside (``bad_layout``). Groups are dated inside their
    document by a fold over its lines, so nothing is shuffled.
    """
    keep = [*doc, year, quarter]
    lines = pin(documents, keep, __lines=F.when(F.col(quarter).isNotNull(), _table_lines(F.col(text), F.col(quarter))))
    folded = pin(lines, [*keep, "__lines"], __days=_days_after(F.col("__lines")))
    cells = explode_rows(folded, keep, _groups(F.col("__lines"), F.col("__days")))
    hour = F.substring("hhmm", 1, 2).try_cast("int")
    minute = F.expr("try_cast(substring(hhmm, 3) AS int)")
    height = F.col("height").try_cast("double")
    event_ts = F.try_make_timestamp(
        F.col(year), column_month(quarter, "column"), F.col("day"), hour, minute, F.lit(0).cast("decimal(8,6)")
    )
    return cells.select(
        *keep, "line_no", "column", "day",
        event_ts.alias("event_ts"), height.alias("height_m"),
        F.when(F.col("day").isNull(), "bad_layout")
        .when(height.isNull(), "bad_height")
        .when(hour.isNull() | minute.isNull(), "bad_time")
        .when(event_ts.isNull(), "bad_date")
        .alias("problem"),
    )


def tide_events(parsed: DataFrame, digits: int = 3) -> DataFrame:
    """Readable events, with their instant."""
    return parsed.where(F.col("problem").isNull()).withColumn("height_m", round_exact("height_m", digits)).drop("problem")


def tide_rejects(parsed: DataFrame) -> DataFrame:
    """Groups set aside; the rest of their document is kept."""
    return parsed.where(F.col("problem").isNotNull())


def tide_history(documents: DataFrame, start_year: int, as_of: Column, doc: Sequence[str] = ("doc",)) -> DataFrame:
    """Events of every quarter's table from ``start_year`` up to the quarter of ``as_of``, with their instants.

    Groups that do not parse carry a ``problem``; they cost neither their table nor the others.
    """
    last = F.year(as_of) * 4 + F.quarter(as_of)
    wanted = documents.where((F.col("year") >= start_year) & (F.col("year") * 4 + F.col("quarter") <= last))
    return parse_tide_tables(wanted, doc).withColumn("origin", F.lit(ORIGIN_TABLE))
