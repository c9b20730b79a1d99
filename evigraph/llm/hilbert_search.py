"""Nearest neighbours along several shifted space-filling curves.

Each curve projects the vectors to ``axes`` random directions, shifts the grid at random, and orders
the cells along a Hilbert curve. Spark range-partitions the keys of all curves at once; places along a
curve are counts before a partition plus the place in it. A curve is cut into tiles of ``tile`` rows.
A query looks at its own tile and at those whose rows can be within ``reach`` places, its finds on all
curves merge, and exact scores on the original vectors rank them.

``reach`` is fitted on a bounded sample of ``sample`` queries: their true neighbours are found by brute
force over all rows, and the reach is the one at which the share ``aim`` of them lies within it on some
curve. So the search widens where the vectors have no structure, and stays narrow where they have.

Inner products need no equal lengths: vectors get one more coordinate that makes all lengths the
largest one, queries get zero there and that length; nearness on the curves is then nearness by inner
product. Equal vectors are one row with their smallest ids, as many as a query can use.

Memory: a task holds one tile and streams the queries past it. Defined results: vectors that are null,
empty, zero or hold null or non-finite components, and rows with a null id, take no part; vectors of
another length than most are in no query's reach but of their own kind (they are searched apart); a
query with fewer candidates than ``k`` gets all that were found. Rows that share an id are each a
candidate. Ids are whole numbers; others are refused by name.
Columns beyond id and vector are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from evigraph.common import cut_lineage

from .vectors import keyed, matrix

AXES, CELL_BITS = 6, 10


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of integer cells (rows, axes), each below 2^bits."""
    x = [c.astype(np.int64) for c in cells.T]
    top = np.int64(1) << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(len(x)):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(flip, x[0] ^ p, x[0]) ^ swap
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = (key << 1) | (((c ^ t) >> b) & 1)
    return key


def curve_keys(points: np.ndarray, curves: int, largest: float, seed: int) -> np.ndarray:
    """Keys (rows, curves) of points of length ``largest``."""
    dim = points.shape[1]
    out = np.empty((len(points), curves), np.int64)
    for c in range(curves):
        rng = np.random.default_rng([seed, dim, c])
        turn = np.linalg.qr(rng.normal(size=(dim, min(AXES, dim))))[0]
        flat = points @ turn / largest * math.sqrt(dim) / 8 + 0.5  # four standard deviations each way
        cells = np.clip((flat + rng.random(turn.shape[1])) / 2 * (1 << CELL_BITS), 0, (1 << CELL_BITS) - 1)
        out[:, c] = hilbert_keys(cells.astype(np.int64), CELL_BITS)
    return out


def _keys(curves: int, largest: float, seed: int):
    """Rows (dim, curve, key, cls, asks, vec): each vector as a candidate and, if it asks, as a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array([len(v) for v in batch.column(2)])
            for dim in np.unique(lengths):
                part = batch.filter(pa.array(lengths == dim))
                asks = part.column(1).to_numpy(zero_copy_only=False)
                x = matrix(part.column(2))
                norm = np.sqrt((x * x).sum(1))
                as_rows = np.column_stack([x, np.sqrt(np.maximum(largest**2 - norm**2, 0))])
                as_asks = np.column_stack([x / norm[:, None] * largest, np.zeros(len(x))])[asks]
                for wanted, points in ((np.ones(len(x), bool), as_rows), (asks, as_asks)):
                    if not wanted.any():
                        continue
                    keys = curve_keys(points, curves, largest, seed)
                    rows = part.filter(pa.array(wanted))
                    n = rows.num_rows
                    is_ask = pa.array(np.full(n, points is as_asks))
                    for c in range(curves):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, c, np.int32)), pa.array(keys[:, c]), rows.column(0), is_ask, rows.column(2)], ["dim", "curve", "key", "cls", "asks", "vec"])

    return run


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest of each row, in no order."""
    return np.argpartition(-scores, k - 1, axis=1)[:, :k] if scores.shape[1] > k else np.broadcast_to(np.arange(scores.shape[1]), scores.shape)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, always added up in the same order."""
    return (a * b).sum(axis=-1)


def _brute(asked: np.ndarray, ids: np.ndarray, k: int):
    """The ``k`` nearest rows of each task to the sampled queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_s, best_c = np.full((len(ids), 0), 0.0), np.zeros((len(ids), 0), np.int64)
        for batch in batches:
            same = np.array([len(v) for v in batch.column(1)]) == asked.shape[1]
            rows = batch.filter(pa.array(same))
            if not rows.num_rows:
                continue
            cls = rows.column(0).to_numpy()
            s = asked @ matrix(rows.column(1)).T
            s[ids[:, None] == cls[None]] = -np.inf
            s, c = np.column_stack([best_s, s]), np.column_stack([best_c, np.broadcast_to(cls, s.shape)])
            at = _best(s, k)
            best_s, best_c = np.take_along_axis(s, at, 1), np.take_along_axis(c, at, 1)
        flat = best_s.reshape(-1)
        ok = np.isfinite(flat)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, best_s.shape[1])[ok]), pa.array(best_c.reshape(-1)[ok]), pa.array(flat[ok])], ["ask", "cls", "score"])

    return run


def _scan_tiles(k: int, curves: int):
    """Rows in order of (dim, curve, tile, asks): a tile's vectors, then the queries that look at it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, vecs, ids, x = None, [], [], None
        for batch in batches:
            where = [batch.column(i).to_numpy() for i in range(3)]
            asks = batch.column(3).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.append(True, np.logical_or.reduce([w[1:] != w[:-1] for w in where]) | (asks[1:] != asks[:-1])))
            for lo, hi in zip(cut, np.append(cut[1:], batch.num_rows)):
                key = tuple(int(w[lo]) for w in where)
                part = batch.slice(lo, hi - lo)
                if key != at:
                    at, vecs, ids, x = key, [], [], None
                if not asks[lo]:
                    vecs.append(matrix(part.column(5)))
                    ids.append(part.column(4).to_numpy())
                    continue
                if not vecs:
                    continue
                if x is None:
                    x, cls = np.concatenate(vecs), np.concatenate(ids)
                for r in range(0, part.num_rows, 512):
                    some = part.slice(r, 512)
                    q, own = matrix(some.column(5)), some.column(4).to_numpy()
                    s = q @ x.T
                    s[own[:, None] == cls[None]] = -np.inf
                    best = _best(s, k)
                    exact = exact_scores(q[:, None, :], x[best])
                    exact[~np.isfinite(np.take_along_axis(s, best, 1))] = -np.inf
                    n, width = best.shape
                    offsets = pa.array(np.arange(0, n * width + 1, width), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.ListArray.from_arrays(offsets, pa.array(cls[best].reshape(-1))), pa.ListArray.from_arrays(offsets, pa.array(exact.reshape(-1)))], ["ask", "found", "scores"])

    return run


def _merge(k: int):
    """The ``k`` nearest classes of each query, from rows in order of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best = None, {}
        out: list[tuple] = []

        def done():
            ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
            out.extend((at, c, s) for c, s in ranked)

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["ask", "cls", "score"])

        for batch in batches:
            for ask, found, scores in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if ask != at:
                    if at is not None:
                        done()
                    at, best = ask, {}
                best.update((c, s) for c, s in zip(found, scores) if s > -math.inf)
            if len(out) > 20_000:
                yield batch_of()
                out = []
        if at is not None:
            done()
        if out:
            yield batch_of()

    return run


def search(
    vectors: DataFrame, is_query: Column, k: int = 20, curves: int = 8, tile: int = 2048, sample: int = 64, aim: float = 0.96, seed: int = 23, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """Columns query_id, rank, id and score of the ``k`` nearest found by inner product, ties to the smaller id."""
    rows = cut_lineage(keyed(vectors, id_col, vec_col).filter("ok").drop("ok").withColumn("asks", is_query))
    kind = "array<float>" if dict(rows.dtypes)["vec"] == "array<float>" else "array<double>"
    rows = rows.withColumn("vec", F.col("vec").cast(kind))
    small = rows.select("k1", "k2", "id").withColumn("place", F.row_number().over(W.partitionBy("k1", "k2").orderBy("id"))).filter(F.col("place") <= k + 1)
    members = small.groupBy("k1", "k2").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    classes = rows.groupBy("k1", "k2").agg(F.min("id").alias("cls"), F.max("asks").alias("asks"), F.any_value("vec").alias("vec")).join(members, ["k1", "k2"])
    classes = cut_lineage(classes)
    square = F.aggregate("vec", F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))
    largest = classes.agg(F.max(square)).first()[0]
    if largest is None:
        return classes.select(F.col("cls").alias("query_id"), F.lit(0).alias("rank"), F.col("cls").alias(id_col), F.lit(0.0).alias("score"))
    points = classes.select("cls", "asks", "vec").mapInArrow(_keys(curves, math.sqrt(largest), seed), f"dim int, curve int, key long, cls long, asks boolean, vec {kind}")
    # Places along each curve: the table is written once, so a lost executor cannot deal it differently.
    dealt = points.repartitionByRange("dim", "curve", "key", "cls").sortWithinPartitions("dim", "curve", "key", "cls", "asks").withColumn("part", F.spark_partition_id())
    dealt = cut_lineage(dealt)
    counts = dealt.groupBy("dim", "curve", "part").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(W.partitionBy("dim", "curve").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.row_number().over(W.partitionBy("dim", "curve", "part").orderBy("key", "cls", "asks")) - 1
    placed = cut_lineage(dealt.withColumn("inside", inside).join(offsets, ["dim", "curve", "part"]).withColumn("place", F.col("inside") + F.col("offset")).select("dim", "curve", "place", "cls", "asks", "vec"))

    reach = fit_reach(classes, placed, k, sample, aim)
    here = F.floor(F.col("place") / tile).cast("int")
    last = placed.groupBy("dim", "curve").agg(F.max(here).alias("last"))
    asked = placed.filter("asks").join(F.broadcast(last), ["dim", "curve"])  # one row per curve
    spread = F.sequence(F.greatest(F.lit(0), F.floor((F.col("place") - reach) / tile).cast("int")), F.least("last", F.floor((F.col("place") + reach) / tile).cast("int")))
    looks = asked.select("dim", "curve", F.explode(spread).alias("tile"), "asks", "cls", "vec")
    tiles = placed.filter("NOT asks").select("dim", "curve", here.alias("tile"), "asks", "cls", "vec")
    found = tiles.unionByName(looks).repartition("dim", "curve", "tile").sortWithinPartitions("dim", "curve", "tile", "asks").mapInArrow(_scan_tiles(k, curves), "ask long, found array<long>, scores array<double>")
    nearest = found.repartition("ask").sortWithinPartitions("ask").mapInArrow(_merge(k), "ask long, cls long, score double")

    # Equal vectors: the query's own class scores too, and each class stands for its ids.
    own = classes.filter("asks AND size(ids) > 1").select(F.col("cls").alias("ask"), "cls", square_of(F.col("vec")).alias("score"))
    listed = nearest.unionByName(own).join(classes.select("cls", "ids"), "cls").select("ask", "score", F.explode("ids").alias("id"))
    cut = W.partitionBy("ask").orderBy(F.desc("score"), "id")
    listed = listed.withColumn("r", F.row_number().over(cut)).filter(F.col("r") <= k + 1).select("ask", "score", "id")
    asks = rows.filter("asks").select("id", "k1", "k2").join(classes.select("k1", "k2", F.col("cls").alias("ask")), ["k1", "k2"]).select(F.col("id").alias("query_id"), "ask")
    final = asks.join(listed, "ask").filter("id <> query_id")
    final = final.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)
    return final.select("query_id", "rank", F.col("id").alias(id_col), "score")


def square_of(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))


def fit_reach(classes: DataFrame, placed: DataFrame, k: int, sample: int, aim: float) -> int:
    """Places within which the share ``aim`` of the true neighbours of at most ``sample`` queries lies on some curve."""
    picked = classes.filter("asks").select("cls", "vec").orderBy(F.xxhash64("cls"), "cls").limit(sample).toPandas()
    worst = 0
    for dim, part in picked.groupby(picked["vec"].map(len)):
        asked = np.stack(part["vec"].to_list()).astype(np.float64)
        ids = part["cls"].to_numpy(dtype=np.int64)
        near = classes.select("cls", "vec").mapInArrow(_brute(asked, ids, k), "ask long, cls long, score double")
        near = near.withColumn("r", F.row_number().over(W.partitionBy("ask").orderBy(F.desc("score"), "cls"))).filter(F.col("r") <= k).select("ask", "cls")
        near = F.broadcast(near)  # at most sample * k rows
        queries = F.broadcast(placed.filter("asks").join(near.select(F.col("ask").alias("cls")).distinct(), "cls").select("dim", "curve", F.col("cls").alias("ask"), F.col("place").alias("from")))
        far = placed.filter("NOT asks").select("dim", "curve", "cls", "place").join(near, "cls").join(queries, ["dim", "curve", "ask"])
        gaps = far.groupBy("ask", "cls").agg(F.min(F.abs(F.col("place") - F.col("from"))).alias("gap")).toPandas()["gap"].to_numpy()
        if len(gaps):
            worst = max(worst, int(np.quantile(gaps, aim, method="higher")))
    return worst
