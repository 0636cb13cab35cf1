"""Exact top-k inner products with a pivot-distance index.

Vectors of integers are lifted by one coordinate, sqrt(M - |v|^2) with M the largest squared norm, and queries by a
zero, so that |q - v|^2 = |q|^2 + M - 2 q.v: the largest inner products are the nearest lifted vectors.  The index
keys every vector by its nearest pivot and its distance to it and is range-partitioned and sorted by that key.  In a
run of one pivot, |d(q, p) - d(v, p)| <= d(q, v), so a query starts at its own distance from the pivot, expands an
annulus on both sides, and stops when the bound exceeds its k-th best.  Scores are exact integers; bounds have a
margin for rounding.

A query first searches the part of the index that it lies in itself, where its nearest annuli are.  The k-th best score
found there is the radius with which it goes to those other parts whose distances from their pivots it can reach, all
queries in one job: parts are dealt to tasks, and a part's queries stream past it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: Products below this are exact in doubles, whatever the order of their sum.
EXACT = float(1 << 52)


def integer_vectors(rows: DataFrame, scale: int = 1024, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, x as double.  Rows with a null id, and vectors that are null
    or hold null or non-finite components, are left out."""
    wide = F.col(vector).cast("array<double>")
    finite = ~F.exists(wide, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    usable = rows.where(F.col(key).isNotNull() & F.coalesce(finite, F.lit(False)))
    return usable.select(F.col(key).cast("long").alias("vec_id"), F.transform(wide, lambda x: F.floor(x * scale)).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _lift(v: np.ndarray, m: float) -> np.ndarray:
    wide = v.astype(np.float64)
    return np.column_stack([wide, np.sqrt(np.maximum(0.0, m - (wide**2).sum(1)))])


def _index_kernel(pivots: np.ndarray, m: float):
    square = (pivots**2).sum(1)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lifted = _lift(_matrix(batch.column(1)), m)
            far = np.sqrt(np.maximum(0.0, (lifted**2).sum(1)[:, None] + square - 2 * lifted @ pivots.T))
            nearest = far.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nearest.astype(np.int32)), pa.array(far[np.arange(len(far)), nearest]), batch.column(0), batch.column(1)], ["pivot", "dist", "vec_id", "v"]
            )

    return kernel


class _Best:
    """The k best (score, smaller id) of one query so far."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids = k, np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(self.scores) >= self.k:
            good = scores >= self.scores[-1]
            scores, ids = scores[good], ids[good]
        if len(scores):
            scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
            keep = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[keep], ids[keep]

    def floor(self) -> int | None:
        return int(self.scores[-1]) if len(self.scores) >= self.k else None


def _dot(block: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return (block @ q).astype(np.int64)
    top = np.iinfo(np.int64)
    return np.array([min(top.max, max(top.min, sum(map(int.__mul__, map(int, row), map(int, q))))) for row in block], np.int64)


def search_run(best: _Best, q: np.ndarray, q_id: int, near: float, dist: np.ndarray, ids: np.ndarray, vectors: np.ndarray, slack: float, reach: float, exact: bool, step: int = 256) -> int:
    """Expand the annulus of one query in one pivot's run (sorted by ``dist``); returns how many vectors were scored.

    ``reach`` is |q|^2 + M: a vector within distance r of the lifted query scores (reach - r^2) / 2.
    """
    low = high = int(np.searchsorted(dist, near))
    seen = 0
    while True:
        floor = best.floor()
        radius = math.inf if floor is None else math.sqrt(max(0.0, reach - 2.0 * floor)) + slack
        left = low > 0 and near - dist[low - 1] <= radius
        right = high < len(dist) and dist[high] - near <= radius
        if not left and not right:
            return seen
        parts = []
        if left:
            start = max(0, low - step, int(np.searchsorted(dist, near - radius)) if radius < math.inf else 0)
            parts.append(slice(start, low))
            low = start
        if right:
            end = min(len(dist), high + step, int(np.searchsorted(dist, near + radius, "right")) if radius < math.inf else len(dist))
            parts.append(slice(high, end))
            high = end
        for part in parts:
            scores, other = _dot(vectors[part], q, exact), ids[part]
            seen += len(other)
            own = other == q_id
            best.add(scores[~own], other[~own])
        step *= 2


_MEETING = "part int, kind int, pivot int, dist double, vec_id long, v array<bigint>, floor long"
_FOUND = "query_id long, vec_id long, score long"


class _Geometry:
    """Distances and bounds of lifted vectors: ``m`` is the largest squared norm."""

    def __init__(self, pivots: np.ndarray, m: float) -> None:
        self.pivots, self.m, self.square = pivots, m, (pivots**2).sum(1)
        # distances come from sums whose error is a few ulps of the largest square
        self.slack = 1e-6 * math.sqrt(3.0 * m + 1.0) + 1e-3
        self.exact = 2.0 * m < EXACT

    def gaps(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distance of each query from each pivot, and |q|^2 + M."""
        wide = queries.astype(np.float64)
        norms = (wide**2).sum(1)
        lifted = np.column_stack([wide, np.zeros(len(wide))])
        return np.sqrt(np.maximum(0.0, norms[:, None] + self.square - 2 * lifted @ self.pivots.T)), norms + self.m

    def radius(self, reach: np.ndarray, floor: np.ndarray, known: np.ndarray) -> np.ndarray:
        """How far a vector may be that scores ``floor`` at least."""
        return np.where(known, np.sqrt(np.maximum(0.0, reach - 2.0 * floor)) + self.slack, np.inf)


def _meet_kernel(geometry: _Geometry, k: int):
    """Rows sorted by part and kind: the vectors of a part (kind 0), by pivot and distance, then its queries (kind 1)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index = None, [], None
        for batch in batches:
            part, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cuts = [0, *(np.nonzero((np.diff(part) != 0) | (np.diff(kind) != 0))[0] + 1).tolist(), len(part)] if len(part) else [0]
            for a, b in zip(cuts, cuts[1:]):
                rows = batch.slice(a, b - a)
                if part[a] != now:
                    now, held, index = part[a], [], None
                columns = [rows.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4)]
                if kind[a] == 0:
                    held.append((*columns, _matrix(rows.column(5))))
                    continue
                if index is None and held:
                    index, held = [np.concatenate(x) for x in zip(*held)], []
                if index is not None:
                    yield from answer(index, columns[2], _matrix(rows.column(5)), rows.column(6))

    def answer(index: list[np.ndarray], ids: np.ndarray, queries: np.ndarray, floor: pa.Array) -> Iterator[pa.RecordBatch]:
        pivot, dist, vec_ids, vectors = index
        known, floors = floor.is_valid().to_numpy(zero_copy_only=False), floor.fill_null(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.nonzero(np.diff(pivot))[0] + 1).tolist(), len(pivot)]
        gaps, reach = geometry.gaps(queries)
        radius = geometry.radius(reach, floors.astype(np.float64), known)
        wide = vectors.astype(np.float64) if geometry.exact else vectors
        found = []
        for i, q_id in enumerate(ids.tolist()):
            best = _Best(k)
            if known[i]:  # what is found already: worse scores cannot be among the k best
                best.scores, best.ids = np.full(k, floors[i], np.int64), np.full(k, np.iinfo(np.int64).max, np.int64)
            q = queries[i].astype(np.float64) if geometry.exact else queries[i]
            for a, b in zip(cuts, cuts[1:]):
                near = gaps[i, pivot[a]]
                if dist[a] - near <= radius[i] and near - dist[b - 1] <= radius[i]:
                    search_run(best, q, q_id, near, dist[a:b], vec_ids[a:b], wide[a:b], geometry.slack, float(reach[i]), geometry.exact)
            own = best.ids != np.iinfo(np.int64).max
            found.append((np.full(own.sum(), q_id), best.ids[own], best.scores[own]))
        columns = [np.concatenate(x) for x in zip(*found)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return kernel


def _reach_kernel(geometry: _Geometry, parts: np.ndarray, low: np.ndarray, high: np.ndarray, pivot: np.ndarray):
    """(part, vec_id, v, floor) of queries to a row for each other part that they can reach.  ``parts`` are the parts'
    runs: each one's pivot, and its least and greatest distance."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                rows = batch.slice(at, 256)
                own = rows.column(0).to_numpy(zero_copy_only=False)
                floor = rows.column(3)
                gaps, reach = geometry.gaps(_matrix(rows.column(2)))
                radius = geometry.radius(reach, floor.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64), floor.is_valid().to_numpy(zero_copy_only=False))
                near = gaps[:, pivot]
                i, j = np.nonzero((low - near <= radius[:, None]) & (near - high <= radius[:, None]))
                to = np.unique(np.stack([i, parts[j]]), axis=1)
                to = to[:, to[1] != own[to[0]]]
                for a in range(0, to.shape[1], 2048):
                    take, part = pa.array(to[0, a : a + 2048]), pa.array(to[1, a : a + 2048].astype(np.int32))
                    yield pa.RecordBatch.from_arrays([part, *(rows.column(c).take(take) for c in (1, 2, 3))], ["part", "vec_id", "v", "floor"])

    return kernel


def _answers(index: DataFrame, queries: DataFrame, geometry: _Geometry, k: int, tasks: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each query in each part that it is sent to (part, vec_id, v, floor)."""
    zero = [F.lit(None).cast(t).alias(n) for n, t in (("pivot", "int"), ("dist", "double"))]
    rows = index.select("part", F.lit(0).alias("kind"), "pivot", "dist", "vec_id", "v", F.lit(None).cast("long").alias("floor"))
    met = rows.unionByName(queries.select("part", F.lit(1).alias("kind"), *zero, "vec_id", "v", "floor"))
    met = met.repartition(tasks, "part").sortWithinPartitions("part", "kind", "pivot", "dist", "vec_id")
    return met.mapInArrow(_meet_kernel(geometry, k), _FOUND)


def build(vectors: DataFrame, pivots: int = 64, part_bytes: int = 32 << 20) -> tuple[DataFrame, np.ndarray, float, int]:
    """The index (part, pivot, dist, vec_id, v) over all rows, its lifted pivots, M, and the number of parts.

    The pivots are a bounded sample: the ``pivots`` rows with the smallest id hashes.  Every row is indexed.  Parts are
    ranges of (pivot, dist, vec_id) of about ``part_bytes``, so a pivot that holds most rows, or one vector that is
    repeated, is cut into many.
    """
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    count, width, m = vectors.agg(F.count("*"), F.max(F.size("v")), F.max(squares)).first()
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    m, parts = m or 0.0, max(2 * vectors.sparkSession.sparkContext.defaultParallelism, count * 8 * (width or 1) // part_bytes)
    lifted = _lift(np.array([r.v for r in chosen], np.int64).reshape(len(chosen), -1), m)
    keyed = vectors.mapInArrow(_index_kernel(lifted, m), "pivot int, dist double, vec_id long, v array<bigint>")
    dealt = keyed.repartitionByRange(parts, "pivot", "dist", "vec_id").withColumn("part", F.spark_partition_id())
    return materialize(dealt, "index"), lifted, m, parts


def search(vectors: DataFrame, is_query: Column, k: int = 10, pivots: int = 64, part_bytes: int = 32 << 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector for which ``is_query`` holds, the ``k`` vectors other than
    itself with the largest inner products, all if there are fewer; ties go to the smaller vec_id.

    ``vectors`` is what :func:`integer_vectors` returns; shorter vectors are filled up with zeros, and scores beyond a
    long are the nearest long.  Rows that share a vec_id are each a candidate, one of them is the query, and none is a
    candidate for their own id.  An empty table, or no query, gives no rows.
    """
    spark = vectors.sparkSession
    widths = vectors.agg(F.max(F.size("v")), F.min(F.size("v"))).first()
    if widths[0] is None:
        return _best(spark.createDataFrame([], _FOUND), k)
    if widths[0] != widths[1]:
        vectors = vectors.withColumn("v", F.transform(F.array_repeat(F.lit(0), widths[0]), lambda _, i: F.coalesce(F.get("v", i), F.lit(0).cast("long"))))
    index, lifted, m, parts = build(vectors, pivots, part_bytes)
    geometry = _Geometry(lifted, m)
    queries = materialize(index.where(is_query).select("part", "vec_id", "v").dropDuplicates(["vec_id"]), "queries")
    near = materialize(_answers(index, queries.withColumn("floor", F.lit(None).cast("long")), geometry, k, parts), "near")
    floors = near.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    # the parts' bounds: a row for each part and pivot, of which there are as many as parts and pivots together
    runs = index.groupBy("part", "pivot").agg(F.min("dist").alias("low"), F.max("dist").alias("high")).toPandas()
    bounds = [runs[c].to_numpy() for c in ("part", "low", "high", "pivot")]
    sent = queries.join(floors, "vec_id", "left").select("part", "vec_id", "v", "floor").mapInArrow(_reach_kernel(geometry, *bounds), "part int, vec_id long, v array<bigint>, floor long")
    return _best(near.unionByName(_answers(index, sent, geometry, k, parts)), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
