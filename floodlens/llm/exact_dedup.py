"""Exact dedup against a persistent digest index.

The index is a table of one row per distinct text (digest, id that stays, number of rows, batch), bucketed and sorted by
digest. A batch is reduced to one row per digest and set against the index by a sort-merge join that does not shuffle the
index: what the anti-join leaves is appended to it, what the index knows already goes to a table of updates, bucketed alike.
Decisions merge both, so an id or a count of a later batch is told as if all batches had come at once. Texts are equal when
their bytes are; null counts as the empty text.

Defined results: rows that repeat an id and its text are one document and share one decision; a null id loses against any
other id; an empty batch leaves the index as it is; a batch that is appended again under its name, say after a failure,
counts once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floodlens.llm.common import cut
from floodlens.session import shared_dir

#: Batches that one whole table comes to the index in.
BATCHES = 3


def digest(text: str | Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), 256))


class DigestIndex:
    """An index at ``path``; the same name and path open it again, also in a later session."""

    def __init__(self, spark: SparkSession, path: str, name: str, buckets: int | None = None) -> None:
        self.spark, self.path, self.name = spark, path, name
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    @classmethod
    def fresh(cls, spark: SparkSession, buckets: int | None = None) -> DigestIndex:
        """A new, empty index in the cluster's shared folder."""
        return cls(spark, shared_dir(spark, "digest-index"), f"digest_index_{uuid.uuid4().hex[:12]}", buckets)

    @property
    def _updates(self) -> str:
        return f"{self.name}_updates"

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name) and self.spark.catalog.tableExists(self._updates)

    def entries(self) -> DataFrame:
        """``digest, keep_id, group_size`` of every distinct text, over all batches.

        Written to the checkpoint folder, without buckets: a join on a digest that many rows share can then be split.
        """
        own = self.spark.table(self.name)
        later = self.spark.table(self._updates).groupBy("digest", "batch").agg(F.max("keep_id").alias("id_"), F.max("group_size").alias("size_"))
        later = later.select(F.col("digest").alias("digest_"), F.col("batch").alias("batch_"), "id_", "size_")
        both = own.join(later.hint("merge"), (F.col("digest") == F.col("digest_")) & (F.col("batch") != F.col("batch_")), "left")
        return cut(both.groupBy("digest").agg(
            F.max(F.greatest("keep_id", "id_")).alias("keep_id"), (F.max("group_size") + F.coalesce(F.sum("size_"), F.lit(0))).alias("group_size")))

    def append(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> None:
        """Add the texts of a batch. Of equal texts, in this batch and those before, the largest id stays."""
        self.append_digests(docs.select(F.col(id_col).alias("id"), digest(text_col).alias("digest")), batch)

    def append_digests(self, rows: DataFrame, batch: str | None = None) -> None:
        """Add rows ``id, digest``."""
        # Cut, or the optimizer moves the anti-join below the aggregate and shuffles every copy of a text.
        new = cut(rows.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")))
        new = new.withColumn("batch", F.lit(batch or uuid.uuid4().hex))
        if not self.exists():
            for name in (self.name, self._updates):
                self._write(new.where("false"), name)
        known = self.spark.table(self.name).select("digest").hint("merge")
        self._write(new.join(known, "digest", "left_semi"), self._updates)
        self._write(new.join(known, "digest", "left_anti"), self.name)

    def _write(self, rows: DataFrame, name: str) -> None:
        (rows.write.mode("append").format("parquet").option("path", f"{self.path}/{name}")
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(name))

    def decide(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``doc_id, keep_id, group_size, kept, text_sha256``: one row per row of ``docs``, all of whose texts the index holds."""
        return self.decide_digests(docs.select(F.col(id_col).alias("id"), digest(text_col).alias("digest")))

    def decide_digests(self, rows: DataFrame) -> DataFrame:
        """The decisions for rows ``id, digest``."""
        return rows.join(self.entries().hint("merge"), "digest", "left").select(
            F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )

    def keep(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: DataFrame | None = None) -> DataFrame:
        """The rows of ``docs`` that stay, once each, with the columns of ``docs``. ``rows``: their ``id, digest``, if at hand."""
        # Joined on digest and id, the copies of a text part before they are shuffled; what repeats both is one document.
        key = ["digest", "id_key"]
        rows = docs.select(F.col(id_col).alias("id"), digest(text_col).alias("digest")) if rows is None else rows
        stays = self.entries().select("digest", _id_key("keep_id").alias("id_key"))
        again = cut(rows.select("digest", _id_key("id").alias("id_key")).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key))
        row = docs.select(F.struct(*docs.columns).alias("row"), digest(text_col).alias("digest"), _id_key(id_col).alias("id_key"))
        if again.isEmpty():
            return row.join(stays.hint("merge"), key).select("row.*")
        alone = row.join(stays.join(again, key, "left_anti").hint("merge"), key).select("row")
        # Of rows that repeat id and text every task passes on one.
        repeated = row.join(stays.join(again, key, "left_semi"), key).groupBy(*key).agg(F.any_value("row").alias("row")).select("row")
        return alone.unionByName(repeated).select("row.*")


def _id_key(id_col: str) -> Column:
    """An id to join by, null included."""
    return F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("null"))


def _indexed(docs: DataFrame, id_col: str, text_col: str, batches: int) -> tuple[DigestIndex, DataFrame]:
    """An index of its own for one whole table, fed batch after batch, and the table's ``id, digest``."""
    index = DigestIndex.fresh(docs.sparkSession)
    rows = cut(docs.select(F.col(id_col).alias("id"), digest(text_col).alias("digest")))
    for k in range(batches):
        index.append_digests(rows.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == k), f"batch {k}")
    return index, rows


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """Decisions for one whole table, whose rows come to the index in batches by a hash of their id."""
    index, rows = _indexed(docs, id_col, text_col, batches)
    return index.decide_digests(rows)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """The rows of one whole table that stay."""
    index, rows = _indexed(docs, id_col, text_col, batches)
    return index.keep(docs, id_col, text_col, rows)
