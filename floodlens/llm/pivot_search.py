"""Exact top-k by inner product through a pivot-distance index.

Whole-number vectors x are lifted by one coordinate, sqrt(M - |x|^2) with M the greatest squared length, queries by 0: then
|q - x|^2 = |q|^2 + M - 2 q.x, and the largest products are the nearest points. Pivots are fitted to a bounded sample; every
vector is keyed by its nearest pivot and its distance from it. Keys are gathered into annuli, runs of distances around one
pivot, cut into blocks of about ``BLOCK_ROWS`` vectors.

By the triangle inequality an annulus [a, b] around a pivot at distance d from the query holds nothing nearer than
max(d - b, a - d). A query walks the annuli in the order of that bound, in rounds of one, four, sixteen and so on; the k-th
score found so far gives a radius, which shrinks from round to round, and the walk ends at the first bound beyond it. Products
are whole numbers, computed exactly: in doubles where they stay below 2**53, else as whole numbers of any size. Queries meet
blocks in groups of bounded size on both sides.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor does a row without id;
shorter vectors count as ending in zeros; rows that repeat an id are candidates of their own, but never of a query of that
id, and such a query is answered once; ties go to the smaller id; components and scores beyond a long count as its ends; an
empty table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from floodlens.llm.common import cut, in_arrow
from floodlens.session import ship_package

SCALE = 1024
TOP = 10
#: Vectors that pivots are fitted to (the first by hash of their id), pivots, and rounds of fitting.
SAMPLE, PIVOTS, ROUNDS = 4_000, 32, 5
#: Steps of distance around a pivot that annuli are made of.
STEPS = 256
BLOCK_ROWS = 2_048
QUERY_ROWS = 512
#: Annuli of a round, as a multiple of those of the round before.
GROWTH = 4
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
_FOUND = "query_id long, vec_id long, score long"


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """``vec_id, x``: floor(scale * component) of every vector that takes part."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(math.inf)))
    taken = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite)
    def whole(c: Column) -> Column:
        return F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(float(_HIGH))), F.lit(float(_LOW)))).cast("long")

    return taken.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, whole).alias("x"))


def _matrix(column: pa.ListArray | pa.ChunkedArray | pd.Series, width: int, kind: type = np.float64) -> np.ndarray:
    """Rows of whole numbers, zeros after their end."""
    if isinstance(column, pd.Series):
        lengths = column.map(len).to_numpy(dtype=np.int64)
        flat = np.concatenate(column.to_list()) if len(column) else np.empty(0)
    else:
        lengths = np.diff(column.offsets.to_numpy())
        flat = column.flatten().to_numpy()
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width).astype(kind)
    out = np.zeros((len(lengths), width), dtype=kind)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(longest - (x**2).sum(axis=1, keepdims=True), 0))])


def fit_pivots(sample: np.ndarray, pivots: int = PIVOTS, rounds: int = ROUNDS) -> np.ndarray:
    """Pivots by a few rounds of k-means from spread-out points of the sample."""
    centres = sample[np.linspace(0, len(sample) - 1, min(pivots, len(sample))).astype(int)]
    for _ in range(rounds):
        near = _distances(sample, centres).argmin(axis=1)
        centres = np.stack([sample[near == i].mean(axis=0) if (near == i).any() else c for i, c in enumerate(centres)])
    return centres


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two whole-number matrices, as longs."""
    most = [max(map(abs, (int(x.min()), int(x.max())))) if x.size else 0 for x in (a, b)]
    if most[0] * most[1] * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    wide = a.astype(object) @ b.T.astype(object)
    return np.clip(wide, _LOW, _HIGH).astype(np.int64)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * a @ b.T, 0))


def _best(products: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of one query, ties to smaller ids."""
    if len(products) > k:
        bar = np.partition(products, len(products) - k)[len(products) - k]
        at = np.flatnonzero(products >= bar)
    else:
        at = np.arange(len(products))
    return at[np.lexsort((ids[at], np.invert(products[at])))[:k]]  # ~s falls as s rises, also at the ends of a long


class PivotIndex:
    """The index of ``vectors`` (``vec_id, x``), held in the checkpoint folder."""

    def __init__(self, vectors: DataFrame, pivots: int = PIVOTS) -> None:
        vectors = cut(vectors)
        shape = vectors.agg(F.max(F.size("x")), F.max(F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))), F.count("*")).first()
        self.width, self.longest, self.rows = shape[0] or 0, float(shape[1] or 0), shape[2]
        if not self.rows:
            return
        sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
        self.pivots = fit_pivots(lifted(_matrix(sample["x"], self.width), self.longest), pivots)
        # Nothing is further from a pivot than two radii of the ball that holds all lifted points.
        self.step = 2 * math.sqrt(self.longest) / STEPS or 1.0
        self.table = cut(self._keyed(vectors))
        bins = self.table.groupBy("pivot", "step").agg(F.count("*").alias("n")).toPandas()  # at most pivots x steps rows
        self.annuli = self._annuli(bins)
        self.parts = {(int(p), s): (a, c) for a, (p, lo, hi, c) in enumerate(self.annuli[["pivot", "low", "high", "cuts"]].itertuples(index=False)) for s in range(lo, hi)}

    def _keyed(self, vectors: DataFrame) -> DataFrame:
        width, pivots, step, longest = self.width, self.pivots, self.step, self.longest

        def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(1), width)
                distance = _distances(lifted(x, longest), pivots)
                near = distance.argmin(axis=1) if len(x) else np.empty(0, np.int64)
                own = distance[np.arange(len(x)), near]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array((own / step).astype(np.int32))], ["vec_id", "x", "pivot", "step"])

        return in_arrow(vectors, key, "vec_id long, x array<long>, pivot int, step int")

    def _annuli(self, bins: pd.DataFrame) -> pd.DataFrame:
        """Runs of steps around each pivot with about a block of vectors; a fuller step is cut into several blocks."""
        out = []
        for pivot, rows in bins.sort_values(["pivot", "step"]).groupby("pivot"):
            low, held = None, 0
            for step, n in zip(rows["step"], rows["n"]):
                if held and held + n > BLOCK_ROWS:
                    out.append((pivot, low, high, held))
                    low, held = None, 0
                low, high, held = step if low is None else low, step + 1, held + n
            out.append((pivot, low, high, held))
        annuli = pd.DataFrame(out, columns=["pivot", "low", "high", "n"])
        annuli["cuts"] = -(-annuli["n"] // BLOCK_ROWS)
        return annuli

    def _bounds(self) -> Callable[[np.ndarray], np.ndarray]:
        """A function that gives, for each query and annulus, a distance that no vector of the annulus is below."""
        pivots, own, margin = self.pivots, self.annuli["pivot"].to_numpy(), 1 + math.sqrt(self.longest)
        low, high = self.annuli["low"].to_numpy() * self.step, self.annuli["high"].to_numpy() * self.step

        def bounds(queries: np.ndarray) -> np.ndarray:
            distance = _distances(np.hstack([queries, np.zeros((len(queries), 1))]), pivots)[:, own]
            return np.maximum(np.maximum(distance - high, low - distance), 0) - 1e-6 * (margin + distance)

        return bounds

    def _blocks(self) -> DataFrame:
        """``block`` of every row: its annulus and one of the annulus's cuts."""
        parts = [(p, s, a, c) for (p, s), (a, c) in self.parts.items()]
        spark = self.table.sparkSession
        table = spark.createDataFrame(parts, "pivot int, step int, annulus int, cuts int")  # at most pivots x steps rows
        cut_of = F.pmod(F.xxhash64("vec_id"), F.col("cuts"))
        return self.table.join(F.broadcast(table), ["pivot", "step"]).select("annulus", cut_of.cast("int").alias("cut"), "vec_id", "x")

    def _visit(self, visits: DataFrame, k: int) -> DataFrame:
        """The k best of each block for the queries sent there. ``visits``: query_id, x, annulus, queries (their group)."""
        ship_package(visits.sparkSession)
        width = self.width
        cuts = visits.sparkSession.createDataFrame([(a, c) for a, c in enumerate(self.annuli["cuts"].tolist())], "annulus int, cuts int")
        each = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut")
        sent = visits.join(F.broadcast(cuts), "annulus").select("query_id", "x", "annulus", "queries", each)
        groups = visits.select("annulus", "queries").distinct()
        blocks = self._blocks().join(groups, "annulus").toDF("annulus_", "cut_", "vec_id", "x_", "queries_")

        def search(sent: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
            ids, out = block["vec_id"].to_numpy(), []
            if len(ids) and len(sent):
                scores = products(_matrix(sent["x"], width, np.int64), _matrix(block["x_"], width, np.int64))
                for query, row in zip(sent["query_id"], scores):
                    others = np.flatnonzero(ids != query)
                    at = others[_best(row[others], ids[others], k)]
                    out.append(pd.DataFrame({"query_id": query, "vec_id": ids[at], "score": row[at]}))
            return pd.concat(out) if out else pd.DataFrame({n: pd.Series(dtype="int64") for n in ("query_id", "vec_id", "score")})

        return sent.groupBy("annulus", "cut", "queries").cogroup(blocks.groupBy("annulus_", "cut_", "queries_")).applyInPandas(search, _FOUND)

    def search(self, queries: DataFrame, k: int = TOP) -> DataFrame:
        """``query_id, rank, vec_id, score`` for ``queries`` (``vec_id, x``)."""
        spark = queries.sparkSession
        if not self.rows:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        queries = cut(queries.groupBy(F.col("vec_id").alias("query_id")).agg(F.first("x").alias("x")))
        groups = max(1, math.ceil(queries.count() / QUERY_ROWS))
        queries = queries.withColumn("queries", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
        width, bounds, longest = self.width, self._bounds(), self.longest
        enough = self.annuli["n"].to_numpy() > k

        def walk(start: int, n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
            """Each query with the annuli ``start`` to ``start + n`` of its order that its radius reaches."""

            def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    x = _matrix(batch.column(1), width)
                    bound = bounds(x)
                    # First the least bound of those with candidates enough, then all others by their bound.
                    first = np.where(enough, bound, np.inf if enough.any() else bound).argmin(axis=1)
                    key = bound.copy()
                    key[np.arange(len(x)), first] = -np.inf
                    order = key.argsort(axis=1, kind="stable")[:, start:start + n]
                    kth = batch.column(3).to_numpy(zero_copy_only=False)
                    # Without k scores so far, or with one at the end of a long, nothing is out of reach.
                    open_ = np.isnan(kth) | (kth <= float(_LOW))
                    radius = np.sqrt(np.maximum((x**2).sum(axis=1) + longest - 2 * np.where(open_, 0, kth), 0))
                    go = (np.take_along_axis(bound, order, axis=1) <= radius[:, None]) | open_[:, None]
                    row, place = np.nonzero(go)
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(3)), pa.array(order[row, place].astype(np.int32))], ["query_id", "x", "queries", "annulus"])

            return visits

        schema = "query_id long, x array<long>, queries int, annulus int"
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        found, start, n = None, 0, 1
        while start < len(self.annuli):
            if found is None:
                state = queries.withColumn("kth", F.lit(None).cast("double"))
            else:
                kth = found.where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("kth"))
                state = queries.join(kth, "query_id", "left")
            visits = cut(in_arrow(state.select("query_id", "x", "queries", "kth"), walk(start, n), schema))
            if visits.isEmpty():  # every query has met a bound beyond its radius
                break
            every = self._visit(visits, k)
            every = every if found is None else every.unionByName(found.select("query_id", "vec_id", "score"))
            found = cut(every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
            start, n = start + n, n * GROWTH
        return found.select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = TOP, scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score``: for rows that ``is_query`` picks, the k others of the greatest product."""
    queries = whole_numbers(vectors.where(is_query), id_col, vector_col, scale)
    return PivotIndex(whole_numbers(vectors, id_col, vector_col, scale)).search(queries, k)


def top_k_sql(every: int = 100, k: int = TOP, scale: int = SCALE) -> str:
    return f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor({scale} * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         list_sum(list_transform(list_zip(q.x, v.x), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0)))::BIGINT AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % {every} = 0
), ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= {k}"""
