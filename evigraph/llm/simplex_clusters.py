"""Centroid clustering in whole numbers, with centroids filtered by n-simplex projection.

Vectors become whole numbers floor(scale * x). A few of them serve as pivots. From its distances to the pivots
a vector gets apex coordinates: the place, over the simplex that the pivots span, of a point at those
distances, with the height above it last. They are computed once and stored beside the vector. The
Euclidean distance of two apexes is at most the distance of the vectors (lower bound); with the heights added
instead of subtracted it is at least that (upper bound). In each round a centroid whose lower bound exceeds
the least upper bound cannot be nearest; the others are compared exactly, in whole numbers.

Bounds are doubles, widened by more than their rounding error, so they never decide a comparison; distances,
sums and floors are exact. Rounds move one partial sum per task and cluster, never vectors; what the driver
sees is one row per cluster and place.

Takes part: a vector of exactly ``width`` components, none null or non-finite. Scaled components beyond 2^27,
whose squared distances need not fit a long, keep a vector out. Ids may be of any type; a null id counts as
empty text in the order of starts. Vectors that share an id are taken one by one, by id and then by
components. Fewer vectors than ``k`` give as many centroids; an empty table gives no rows. Ties go to the
smaller cluster number. Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from evigraph.common import cut_lineage

PIVOTS = 8
LIMIT = 1 << 27
SLACK = 1e-9


def whole(vectors: DataFrame, id_col: str, vec_col: str, width: int, scale: int) -> DataFrame:
    """(vec_id, q): the vectors that take part, in whole numbers."""
    x = lambda v: v.cast("double") * scale
    fits = (F.size(vec_col) == width) & F.forall(vec_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(x(v)) <= LIMIT))
    return vectors.filter(F.coalesce(fits, F.lit(False))).select(F.col(id_col).alias("vec_id"), F.transform(vec_col, lambda v: F.floor(x(v)).cast("long")).alias("q"))


class Simplex:
    """Apex coordinates over pivots; pivots that lie in the span of earlier ones are left out."""

    def __init__(self, pivots: np.ndarray):
        base = pivots[0].astype(np.float64)
        rows: list[np.ndarray] = []  # lower triangle: edges of the simplex in its own coordinates
        used = [pivots[0]]
        for pivot in pivots[1:]:
            edge = pivot.astype(np.float64) - base
            known = np.array([(used[i + 1].astype(np.float64) - base) @ edge for i in range(len(rows))])
            inner = np.linalg.solve(np.array([r[: len(rows)] for r in rows]), known) if rows else np.zeros(0)
            height = edge @ edge - inner @ inner
            if height > 1e-6 * max(1.0, edge @ edge):
                rows = [np.append(r, 0.0) for r in rows] + [np.append(inner, np.sqrt(height))]
                used.append(pivot)
        self.pivots = np.array(used, np.float64)
        self.edges = np.array(rows).reshape(len(rows), len(rows))
        self.lengths = (self.edges**2).sum(axis=1)

    def apex(self, q: np.ndarray) -> np.ndarray:
        """One row of coordinates per vector, from its distances to the pivots; the height is the last."""
        squares = ((q[:, None, :].astype(np.float64) - self.pivots[None, :, :]) ** 2).sum(axis=2)
        right = (squares[:, :1] - squares[:, 1:] + self.lengths) / 2
        flat = np.linalg.solve(self.edges, right.T).T if len(self.edges) else right
        height = np.sqrt(np.maximum(squares[:, 0] - (flat**2).sum(axis=1), 0.0))
        return np.column_stack([flat, height])


def bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances between the vectors behind two sets of apexes."""
    flat = ((a[:, None, :-1] - b[None, :, :-1]) ** 2).sum(axis=2)
    low = flat + (a[:, None, -1] - b[None, :, -1]) ** 2
    high = flat + (a[:, None, -1] + b[None, :, -1]) ** 2
    slack = SLACK * (1.0 + (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :])
    return low - slack, high + slack


def nearest(q: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, centre_apexes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Cluster and exact squared distance per vector, and how many exact comparisons that took."""
    low, high = bounds(apexes, centre_apexes)
    open_ = low <= high.min(axis=1)[:, None]
    best = np.full(len(q), np.iinfo(np.int64).max)
    cluster = np.zeros(len(q), np.int32)
    for c in range(len(centroids)):
        rows = np.flatnonzero(open_[:, c])
        apart = ((q[rows] - centroids[c]) ** 2).sum(axis=1)
        closer = apart < best[rows]
        best[rows[closer]] = apart[closer]
        cluster[rows[closer]] = c
    return cluster, best, int(open_.sum())


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def with_apexes(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Rows with their apex coordinates."""
    simplex = Simplex(pivots)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                apexes = simplex.apex(_matrix(b.column("q"), np.int64))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(apexes), pa.list_(pa.float64()))], [*b.schema.names, "apex"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(project, f"vec_id {kind}, q array<long>, apex array<double>")


def _step(rows: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Next centroids: floors of the means; clusters without vectors keep theirs."""
    k, width = centroids.shape
    centre_apexes = Simplex(pivots).apex(centroids)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for b in batches:
            if b.num_rows:
                q = _matrix(b.column("q"), np.int64)
                cluster, _, _ = nearest(q, _matrix(b.column("apex"), np.float64), centroids, centre_apexes)
                for c in np.unique(cluster):
                    total[c] += q[cluster == c].sum(axis=0)
                    count[c] += (cluster == c).sum()
        hit = np.flatnonzero(count)
        cols = [np.repeat(hit, width), np.tile(np.arange(width), len(hit)), total[hit].ravel(), np.repeat(count[hit], width)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["cluster", "place", "total", "n"])

    parts = rows.select("q", "apex").mapInArrow(sums, "cluster long, place long, total long, n long")
    # a task's sum is at most its rows times 2^27; over all tasks it is kept in decimals
    whole = parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"), F.sum("n").alias("n"))
    new = centroids.copy()
    for row in whole.collect():  # k x width rows
        new[row["cluster"], row["place"]] = int(row["total"]) // row["n"]
    return new


def assigned(rows: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    centre_apexes = Simplex(pivots).apex(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cluster, distance, _ = nearest(_matrix(b.column("q"), np.int64), _matrix(b.column("apex"), np.float64), centroids, centre_apexes)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long")


def cluster(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", width: int = 64, scale: int = 1024, k: int = 8, rounds: int = 10, seed: str = "3", pivots: int = PIVOTS
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and the final centroid of each vector's cluster."""
    spark = vectors.sparkSession
    rows = whole(vectors, id_col, vec_col, width, scale)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = [r["q"] for r in rows.withColumn("order", order).orderBy("order", "q").limit(max(k, pivots)).collect()]  # a fixed number of vectors
    kind = rows.schema["vec_id"].dataType.simpleString()
    columns = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    if not first:
        return spark.createDataFrame([], columns)
    chosen = np.array(first, np.int64)
    centroids, anchors = chosen[:k], chosen[:pivots]
    rows = cut_lineage(with_apexes(rows, anchors))
    for _ in range(rounds):
        new = _step(rows, centroids, anchors)
        if (new == centroids).all():
            break  # nothing moves any more
        centroids = new
    out = cut_lineage(assigned(rows, centroids, anchors))
    sums = {r["cluster"]: r["s"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    table = [(c, s, sum(sums.values()), [int(x) for x in centroids[c]]) for c, s in sums.items()]
    table = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return out.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def centroid_digest(centroid: Column) -> Column:
    """Hex SHA-256 of the components as decimal numbers joined by commas."""
    return F.sha2(F.array_join(F.transform(centroid, lambda x: x.cast("string")), ","), 256)
