"""Raw-zone and snapshot tables, and their upkeep."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from floodlens.schemas import SNAPSHOT_COLUMNS


def land_raw(
    raw: DataFrame, path: str, checkpoint: str, once: bool = False, interval: str = "60 seconds"
) -> StreamingQuery:
    """Append a raw stream as Parquet by source and date, exactly once, with its own checkpoint."""
    writer = (
        raw.writeStream.format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint)
        .partitionBy("source", "date").outputMode("append")
    )
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return writer.start()


def write_snapshots(
    scored: DataFrame, path: str, epoch_id: int, as_of: str | None = None, run_id: str = "manual"
) -> None:
    """Append scored rows by date, replaceable by run and epoch: a repeated epoch overwrites itself.

    Epoch numbers begin anew with every stream checkpoint, so ``run_id`` (the id of the stream, which
    its checkpoint keeps) tells the epochs of different checkpoints apart.
    ``as_of`` fixes the stamp; otherwise it is the time of writing.
    """
    now = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    rows = scored.withColumn("computed_at", now).withColumn("date", F.to_date("computed_at"))
    (
        rows.select(*SNAPSHOT_COLUMNS, F.lit(run_id).alias("run_id"), F.lit(epoch_id).cast("long").alias("epoch_id"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("date", "run_id", "epoch_id").parquet(path)
    )


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return read_landed(spark, path).select(*SNAPSHOT_COLUMNS)


MARK_SCHEMA = "date DATE, run_id STRING, epoch_id BIGINT, copy STRING, marked_at TIMESTAMP"


def _marks(spark: SparkSession, path: str) -> DataFrame | None:
    """What the newest copy of each date holds: a row per run with its last epoch; None before any compaction."""
    try:
        marks = spark.read.schema(MARK_SCHEMA).parquet(f"{path}_marks")
    except AnalysisException:  # nothing has been compacted
        return None
    newest = marks.groupBy("date").agg(F.max_by("copy", F.struct("marked_at", "copy")).alias("copy"))
    return marks.join(newest, ["date", "copy"])


def _live(spark: SparkSession, path: str) -> DataFrame:
    """The rows that are not only in a copy; none where all folders have expired."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        closed = spark.read.parquet(f"{path}_closed")
        fields = [f for f in closed.schema.fields if f.name not in ("date", "copy")]
        own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        return spark.createDataFrame([], f"{own}, date DATE, run_id STRING, epoch_id BIGINT")


def compact_closed(spark: SparkSession, path: str, before: str, files: int = 1) -> int:
    """Copy the dates before ``before`` of a table landed by run and epoch into ``files`` files each.

    Run it on a schedule. A date is copied when it has epochs that its newest copy lacks, late rows
    included; the new copy takes over the rows of the old one. Every copy has a folder of its own and
    counts once its mark is written, so readers of :func:`read_landed` always see each row once.
    Returns the number of dates copied.
    """
    live = _live(spark, path).where(F.col("date") < F.lit(before).cast("date"))
    epochs = live.groupBy("date", "run_id").agg(F.max("epoch_id").alias("epoch_id"))  # partition values only
    marks = _marks(spark, path)
    if marks is not None:
        held_before = marks.select("date", "run_id", F.col("epoch_id").alias("__held"))
        epochs = epochs.join(held_before, ["date", "run_id"], "left").where(F.col("__held").isNull() | (F.col("epoch_id") > F.col("__held"))).drop("__held")
    dates = [r["date"] for r in epochs.select("date").distinct().collect()]
    if not dates:
        return 0
    copy = uuid.uuid4().hex[:12]
    # What lands from here on is not in the copy, so its epochs are fixed first; runs whose folders are gone stay in the mark.
    held = live.where(F.col("date").isin(dates)).select("date", "run_id", "epoch_id")
    if marks is not None:
        held = held.unionByName(marks.where(F.col("date").isin(dates)).select("date", "run_id", "epoch_id"))
    held = held.groupBy("date", "run_id").agg(F.max("epoch_id").alias("epoch_id")).collect()
    held = spark.createDataFrame([(*r, copy) for r in held], "date DATE, run_id STRING, epoch_id BIGINT, copy STRING")
    upto = held.select("date", "run_id", F.col("epoch_id").alias("__upto"))
    rows = _each_row_once(spark, path, upto).where(F.col("date").isin(dates))
    (
        rows.withColumn("copy", F.lit(copy)).repartition(files * len(dates), "date", F.pmod(F.monotonically_increasing_id(), F.lit(files)))
        .write.mode("append").partitionBy("date", "copy").parquet(f"{path}_closed")
    )
    held.withColumn("marked_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{path}_marks")
    return len(dates)


def _each_row_once(spark: SparkSession, path: str, upto: DataFrame | None = None) -> DataFrame:
    """Compacted dates from their newest copy, all that the copies lack from the table, up to the epochs of ``upto``."""
    live = _live(spark, path)
    if upto is not None:
        live = live.join(F.broadcast(upto), ["date", "run_id"]).where(F.col("epoch_id") <= F.col("__upto")).drop("__upto")
    marks = _marks(spark, path)
    if marks is None:
        return live.drop("run_id", "epoch_id")
    # One row per compacted date and run.
    last = F.broadcast(marks.select("date", "run_id", F.col("epoch_id").alias("__last")))
    fresh = live.join(last, ["date", "run_id"], "left").where(F.col("__last").isNull() | (F.col("epoch_id") > F.col("__last")))
    fresh = fresh.drop("run_id", "epoch_id", "__last")
    closed = spark.read.parquet(f"{path}_closed").join(F.broadcast(marks.select("date", "copy").distinct()), ["date", "copy"])
    return fresh.unionByName(closed.select(*fresh.columns))


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """A table landed by run and epoch: compacted dates from their newest copy, all that the copies lack from the table.

    ``run_id`` and ``epoch_id`` are left out: a copy does not keep them.
    """
    return _each_row_once(spark, path)


def expire_closed(spark: SparkSession, path: str, grace: str = "1 day") -> int:
    """Delete the folders that a copy has replaced for longer than ``grace``: epochs of the table, and older copies.

    ``grace`` is for readers that planned before the copy's mark was written. Rows landed since are
    not touched, and :func:`read_landed` gives the same rows as before. Returns the number of folders.
    """
    marks = _marks(spark, path)
    if marks is None:
        return 0
    settled = marks.where(F.col("marked_at") < F.current_timestamp() - F.expr(f"interval {grace}"))
    own = settled.select("date", "run_id", F.col("epoch_id").alias("__last"))
    source = _live(spark, path)
    by = [f"{c}={{{i}}}" for i, c in enumerate(_partition_columns(source, path))]
    epochs = source.select("date", "run_id", "epoch_id").distinct().join(F.broadcast(own), ["date", "run_id"]).where(F.col("epoch_id") <= F.col("__last"))
    newest = settled.select("date", F.col("copy").alias("__copy")).distinct()
    copies = spark.read.parquet(f"{path}_closed").select("date", "copy").distinct().join(F.broadcast(newest), "date").where(F.col("copy") != F.col("__copy"))
    # One row per folder of closed dates, told by partition values alone.
    folders = [f"{path}/" + "/".join(by).format(r["date"], r["run_id"], r["epoch_id"]) for r in epochs.collect()]
    folders += [f"{path}_closed/date={r['date']}/copy={r['copy']}" for r in copies.collect()]
    return sum(_delete(spark, folder) for folder in folders)


def _partition_columns(table: DataFrame, path: str) -> list[str]:
    """The columns that expired folders are named by, outermost first."""
    wanted = ["date", "run_id", "epoch_id"]
    if table.columns[-3:] != wanted:
        raise ValueError(f"{path} is not a table by date, run and epoch")
    return wanted


def _delete(spark: SparkSession, folder: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
