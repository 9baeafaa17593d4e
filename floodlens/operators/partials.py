"""Region and day means kept as sums and counts that merge, renewed only where the cells changed.

The cells lie in a table of files, partitioned by a date column (a day, or the first day of a month). What the files of a
partition look like (path, size, time) is its stamp; partitions whose stamp differs from the stored one are read again, all
others keep their sums. Sums and counts of parts add up to those of the whole, so means of a day, a month or all time come
from the stored rows and never touch a cell.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floodlens.functions.geometry import OCEAN_REGIONS, Box, regions_of

STAMP_SCHEMA = "digest DECIMAL(38,0), files BIGINT, part DATE"


class RegionPartials:
    """Sums and counts of the cells of ``source`` per region and day, stored at ``path``.

    ``values`` maps a column to the divisor of its stored whole numbers; ``part`` is the partition column of the source.
    """

    def __init__(
        self, spark: SparkSession, source: str, path: str, values: Mapping[str, float], boxes: Sequence[Box] = OCEAN_REGIONS,
        part: str = "date", date: str = "date", lat: str = "lat", lon: str = "lon",
    ) -> None:
        self.spark, self.source, self.path, self.values, self.boxes = spark, source, path, dict(values), tuple(boxes)
        self.part, self.date, self.lat, self.lon = part, date, lat, lon

    @property
    def schema(self) -> str:
        sums = ", ".join(f"sum_{c} DOUBLE, n_{c} BIGINT" for c in self.values)
        return f"region STRING, date DATE, {sums}, n_cells BIGINT, part DATE"

    def _stored(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException:  # nothing has been stored yet
            return self.spark.createDataFrame([], schema)

    def _stamps(self) -> DataFrame:
        """``digest, files, part`` of the source's partitions, from what its files look like; no cell is read."""
        files = self.spark.read.parquet(self.source).select(
            F.col(self.part).cast("date").alias("part"), "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        mark = F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)")
        return files.groupBy("part").agg(F.sum(mark).cast("decimal(38,0)").alias("digest"), F.count(F.lit(1)).alias("files")).select("digest", "files", "part")

    def changed(self) -> DataFrame:
        """Stamps of the partitions that are new, differ from the stored ones, or are gone (no files)."""
        now, before = self._stamps(), self._stored("stamps", STAMP_SCHEMA)
        other = now.join(before, ["part", "digest", "files"], "left_anti").select("digest", "files", "part")
        gone = before.where("files > 0").join(now, "part", "left_anti").select(F.lit(0).cast("decimal(38,0)").alias("digest"), F.lit(0).cast("bigint").alias("files"), "part")
        return other.unionByName(gone)

    def _partials(self, cells: DataFrame) -> DataFrame:
        members = cells.select(
            F.col(self.date).cast("date").alias("date"), *self.values, F.col(self.part).cast("date").alias("part"),
            F.explode(regions_of(self.lat, self.lon, self.boxes)).alias("region"))
        sums = [x for c in self.values for x in (F.sum(c).cast("double").alias(f"sum_{c}"), F.count(c).alias(f"n_{c}"))]
        return members.groupBy("region", "date", "part").agg(*sums, F.count(F.lit(1)).alias("n_cells"))

    def refresh(self) -> int:
        """Bring the stored sums up to the source; the number of partitions that were read again.

        Sums are replaced partition by partition, stamps after them: a refresh that breaks off is made good by the next one.
        """
        stamps = self.changed().collect()  # one row per changed partition
        if not stamps:
            return 0
        renewed = [r["part"] for r in stamps if r["files"]]
        if renewed:
            cells = self.spark.read.parquet(self.source).where(F.col(self.part).cast("date").isin(renewed))
            # A row without region per partition, so that one whose cells all moved away is replaced too.
            marks = self.spark.createDataFrame([(p,) for p in renewed], "part DATE")
            self._write(self._partials(cells).unionByName(marks, allowMissingColumns=True), "partials")
        self._write(self.spark.createDataFrame(stamps, STAMP_SCHEMA), "stamps")
        return len(renewed)

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{self.path}/{name}")

    def stored(self) -> DataFrame:
        """The stored sums of the partitions that the source still has."""
        live = self._stored("stamps", STAMP_SCHEMA).where("files > 0").select("part")
        return self._stored("partials", self.schema).where(F.col("region").isNotNull()).join(live, "part", "left_semi")

    def means(self, level: str = "day", digits: int = 6) -> DataFrame:
        """Mean per region and day, month or year (its first day as ``date``), or per region over all time, from the sums."""
        levels: dict[str, Column | None] = {"day": F.col("date"), "month": F.trunc("date", "month"), "year": F.trunc("date", "year"), "all": None}
        at = levels[level]
        keys = ["region"] if at is None else ["region", at.alias("date")]
        merged = self.stored().groupBy(*keys)
        shown = [
            F.round(F.sum(f"sum_{c}") / F.nullif(F.sum(f"n_{c}"), F.lit(0)) / F.lit(float(scale)), digits).alias(f"mean_{c}") for c, scale in self.values.items()]
        return merged.agg(*shown, F.sum("n_cells").alias("n_cells"))
