"""Hard negatives by Kronecker-packed products.

Vectors are whole numbers. Several candidates are packed into one wide integer per component: less the least component of
their block they are not negative, and each lies in a field of its own. An anchor's component is multiplied once with that
integer, for all its candidates; the sum over the components holds their exact inner products in the same fields, lifted by
an offset that keeps every field from turning negative, and shifts and masks take them out. A field is as wide as the block's
greatest sum, so none runs over into the next. Integers have 63 bits where two fields or more fit in; where products are
greater they are Python's, of any width.

Anchors and candidates meet in blocks of bounded size on both sides. An anchor's positives come from the blocks of its own
label, which are cut by hash, however many rows it has; then anchors go with their positives to blocks of all rows, each of
which returns at most ``most`` negatives for an anchor and positive.

Defined results: rows without id or label, and vectors that are null or hold null or non-finite components, take no part;
shorter vectors, empty ones too, end in zeros. A row is no positive of an anchor of its id; an id that repeats among anchors
is one anchor, of its least label and vector. Ties go to the smaller id, then to the least label and vector. Components and
scores beyond a long count as its ends. An anchor without a positive, or a pair without a negative, has no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from floodlens.llm.common import cut
from floodlens.session import ship_package

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these hundredths of the positive's.
LEAST, MOST = 50, 95
#: Rows of a block of candidates, anchors that visit one together, and candidates handled at once.
BLOCK_ROWS, ANCHOR_ROWS = 4_096, 1_024
#: Bits of a machine integer that are used, and fields of a wider one.
BITS, WIDE_FIELDS = 63, 16
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
_FOUND = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def whole_numbers(rows: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """``vec_id, label, x`` (floor(scale * component)) of the rows that take part."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(math.inf)))
    taken = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & finite)

    def whole(c: Column) -> Column:
        c = F.greatest(F.least(c.cast("double") * scale, F.lit(float(_HIGH))), F.lit(float(_LOW)))
        return F.floor(c).cast("long")

    return taken.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.transform(v, whole).alias("x"))


def _matrix(vectors: Sequence[np.ndarray], width: int) -> np.ndarray:
    """Rows of whole numbers, zeros after their end."""
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for row, v in zip(out, vectors):
        row[:len(v)] = v
    return out


class PackedBlock:
    """Candidates ``x``, rows of whole numbers, packed for anchors with a bound on their components."""

    def __init__(self, x: np.ndarray, up: int, down: int) -> None:
        """``up`` and ``down``: the greatest sum of an anchor's positive components, and of its negative ones without sign."""
        self.rows, self.low, high = len(x), int(x.min()), int(x.max())
        span = high - self.low
        self.offset = span * down
        self.width = max(1, (self.offset + span * up).bit_length())
        self.narrow = 2 * self.width <= BITS and max(-self.low, high) * (up + down) < 1 << (BITS - 1)
        self.fields = BITS // self.width if self.narrow else WIDE_FIELDS
        kind = np.int64 if self.narrow else object
        lifted = x.astype(kind) - self.low
        lifted = np.concatenate([lifted, np.zeros((-self.rows % self.fields, x.shape[1]), dtype=kind)])
        lifted = lifted.reshape(self.fields, -1, x.shape[1])  # row f * n + i lies in field f of integer i
        packed = sum((lifted[f] << (self.width * f) for f in range(self.fields)), np.zeros(lifted.shape[1:], dtype=kind))
        self.packed = np.ascontiguousarray(packed.T)
        self.lift = sum(self.offset << (self.width * f) for f in range(self.fields))

    def products(self, anchor: np.ndarray) -> np.ndarray:
        """Exact inner products of ``anchor`` with all candidates; whole numbers of any size where the block is not narrow."""
        total = np.full(self.packed.shape[1], self.lift, dtype=self.packed.dtype)
        for component, wide in zip(anchor.tolist(), self.packed):
            if component:
                total += component * wide
        mask = (1 << self.width) - 1
        fields = np.concatenate([(total >> (self.width * f)) & mask for f in range(self.fields)])[:self.rows]
        return fields - self.offset + self.low * sum(anchor.tolist())


def _scores(anchors: np.ndarray, candidates: np.ndarray) -> Iterator[np.ndarray]:
    """For each anchor its scores with all candidates, as longs."""
    up = max((sum(c for c in a if c > 0) for a in anchors.tolist()), default=0)
    down = max((-sum(c for c in a if c < 0) for a in anchors.tolist()), default=0)
    block = PackedBlock(candidates, up, down)
    for anchor in anchors:
        products = block.products(anchor)
        yield products if block.narrow else np.array([min(max(s, _LOW), _HIGH) for s in products.tolist()], dtype=np.int64)


def _first(scores: np.ndarray, ids: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
    """Of the places ``at`` the ``most`` first by descending score, ties by id and place."""
    if len(at) > most:
        bar = np.partition(scores[at], len(at) - most)[len(at) - most]
        at = at[scores[at] >= bar]
    return at[np.lexsort((ids[at], np.invert(scores[at])))[:most]]  # ~s falls as s rises, also at the ends of a long


def bounds(positive: int, least: int = LEAST, most: int = MOST) -> tuple[int, int]:
    """The least and the greatest score of a negative."""
    return max(-(-least * positive // 100), _LOW), min(most * positive // 100, _HIGH)


def _in_blocks(rows: DataFrame, size: int) -> int:
    return max(1, math.ceil(rows.count() / size))


class Miner:
    """Anchors and their rows, in blocks. ``rows``: vec_id, label, x; ``anchors``: those of ``rows`` to mine for."""

    def __init__(self, rows: DataFrame, anchors: DataFrame) -> None:
        self.rows = cut(rows)
        self.anchors = cut(anchors.groupBy(F.col("vec_id").alias("anchor_id")).agg(F.min(F.struct("label", "x")).alias("a")).select("anchor_id", "a.label", "a.x"))
        self.width = max(1, self.rows.agg(F.max(F.size("x"))).first()[0] or 0)
        ship_package(rows.sparkSession)

    def positives(self, most: int = POSITIVES) -> DataFrame:
        """``anchor_id, positive_id, positive_score``: an anchor's best others of its label."""
        width = self.width
        # One row per label that has an anchor: how many blocks of rows and groups of anchors it is cut into.
        groups = self.anchors.groupBy("label").agg(F.ceil(F.count("*") / ANCHOR_ROWS).cast("long").alias("groups"))
        blocks = self.rows.groupBy("label").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("long").alias("blocks"))
        cuts = cut(groups.join(blocks, "label"))
        anchors = self.anchors.join(cuts, "label").withColumn("group", F.pmod(F.xxhash64("anchor_id"), "groups"))
        anchors = anchors.withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)"))).select("label", "block", "group", "anchor_id", "x")
        rows = self.rows.join(cuts, "label").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks"))
        rows = rows.withColumn("group", F.explode(F.expr("sequence(0L, groups - 1)"))).select("label", "block", "group", "vec_id", "x")

        def search(anchors: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
            ids, out = block["vec_id"].to_numpy(), []
            if len(ids) and len(anchors):
                for anchor, scores in zip(anchors["anchor_id"], _scores(_matrix(anchors["x"], width), _matrix(block["x"], width))):
                    at = _first(scores, ids, np.flatnonzero(ids != anchor), most)
                    out.append(np.stack([np.full(len(at), anchor), ids[at], scores[at]], axis=1))
            return pd.DataFrame(np.concatenate(out) if out else np.empty((0, 3), np.int64), columns=["anchor_id", "positive_id", "positive_score"])

        key = ["label", "block", "group"]
        found = anchors.groupBy(*key).cogroup(rows.groupBy(*key)).applyInPandas(search, "anchor_id long, positive_id long, positive_score long")
        best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).drop("rank")

    def negatives(self, positives: DataFrame, most: int = NEGATIVES, least_share: int = LEAST, most_share: int = MOST) -> DataFrame:
        """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``."""
        width = self.width
        # A few positives an anchor; those that repeat id and score are one.
        pairs = positives.groupBy("anchor_id").agg(F.collect_set(F.struct("positive_score", "positive_id")).alias("positives"))
        anchors = cut(self.anchors.join(pairs, "anchor_id"))
        blocks, groups = _in_blocks(self.rows, BLOCK_ROWS), _in_blocks(anchors, ANCHOR_ROWS)
        each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
        sent = anchors.select("*", F.pmod(F.xxhash64("anchor_id"), F.lit(groups)).cast("int").alias("group")).select("*", each)
        rows = self.rows.select("*", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
        rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))

        def search(anchors: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
            ids, labels, out = block["vec_id"].to_numpy(), block["label"].to_numpy(), []
            if len(ids) and len(anchors):
                scored = zip(anchors["anchor_id"], anchors["label"], anchors["positives"], _scores(_matrix(anchors["x"], width), _matrix(block["x"], width)))
                for anchor, label, positives, scores in scored:
                    other = (labels != label) & (ids != anchor)
                    for p in positives:
                        low, high = bounds(int(p["positive_score"]), least_share, most_share)
                        at = _first(scores, ids, np.flatnonzero(other & (scores >= low) & (scores <= high)), most)
                        same = [np.full(len(at), v) for v in (anchor, p["positive_id"], p["positive_score"])]
                        out.append(np.stack([*same, ids[at], scores[at]], axis=1))
            names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
            return pd.DataFrame(np.concatenate(out) if out else np.empty((0, 5), np.int64), columns=names)

        key = ["block", "group"]
        found = sent.groupBy(*key).cogroup(rows.groupBy(*key)).applyInPandas(search, _FOUND)
        best = Window.partitionBy("anchor_id", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
        return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(
    rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST,
) -> DataFrame:
    """Negatives whose score is between ``least`` and ``most`` hundredths of a positive's, for the rows that ``is_anchor`` picks."""
    anchors = whole_numbers(rows.where(is_anchor), id_col, label_col, vector_col, scale)
    miner = Miner(whole_numbers(rows, id_col, label_col, vector_col, scale), anchors)
    return miner.negatives(cut(miner.positives(positives)), negatives, least, most)


def hard_negatives_sql(
    table: str = "embeddings", label: str = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END", every: int = 50, scale: int = SCALE,
    positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST,
) -> str:
    return f"""
WITH v AS (
  SELECT vec_id, {label} AS label, list_transform(embedding, lambda c: floor({scale} * c::DOUBLE)::BIGINT) AS x FROM {table}
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same,
         list_sum(list_transform(list_zip(a.x, v.x), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0)))::BIGINT AS score
  FROM v AS a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % {every} = 0
), best AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
  FROM scored WHERE same
), positive AS (SELECT DISTINCT anchor_id, positive_id, positive_score FROM best WHERE place <= {positives}
), ranked AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id, p.positive_score ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM positive p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same
  WHERE {least} * p.positive_score <= 100 * s.score AND 100 * s.score <= {most} * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= {negatives}"""
