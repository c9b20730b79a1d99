"""Embedding near-dedup by sorted projection passes.

Each pass orders the vectors lexicographically by a string of random sign hashes of its own: slim rows
(pass, string, id) are range-partitioned and sorted, and their places cut the order into tiles. Every tile
is compared with itself and the next one, so each vector meets at least the ``tile`` vectors on either side,
whatever bits they differ in. A run of vectors with equal leading ``bits`` may be longer than that, such as
a large group of near copies: then all pairs of its tiles are compared too. Windows bound a task's memory,
never what is found in a run.

``bits`` follows from the number of vectors, so that a run of unrelated vectors holds about ``window`` rows,
and the number of passes follows from ``bits``, so that a pair at exactly ``cos`` shares a run with
probability ``recall`` (closer pairs more surely); windows across the borders of runs come on top.

A pair counts in the first pass where it meets, which the places of both in the earlier passes tell; tasks
return links per vector and a spanning forest, so no pair is ever written. Equal vectors are one class with a
size and are compared once.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with
a null id, link with nothing (no links, the id as component). Rows that share an id count each.
Vectors of different length never link. Ids are whole numbers; others are refused by name.
Columns beyond id and vector are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from evigraph.common import cut_lineage

from .common import components
from .vectors import keyed, matrix

STRING = 48


def plan(n: int, cos: float, window: int, recall: float) -> tuple[int, int]:
    """Leading bits and passes for ``n`` distinct vectors."""
    bits = max(0, min(STRING, round(math.log2(max(1, n) / window))))
    meet = (1 - math.acos(cos) / math.pi) ** bits
    return bits, 1 if bits == 0 else math.ceil(math.log(1 - recall) / math.log(1 - meet))


def planes(dim: int, passes: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).normal(size=(dim, passes * STRING))


def sign_strings(x: np.ndarray, passes: int, seed: int) -> np.ndarray:
    """Hash strings as numbers, (rows, passes); the first hash is the highest bit."""
    bits = (x @ planes(x.shape[1], passes, seed) >= 0).reshape(len(x), passes, STRING)
    return bits.astype(np.int64) @ (np.int64(1) << np.arange(STRING - 1, -1, -1, dtype=np.int64))


def _strings(passes: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array([len(v) for v in batch.column(1)])
            for dim in np.unique(lengths):
                part = batch.filter(pa.array(lengths == dim))
                strings = sign_strings(matrix(part.column(1)), passes, seed)
                for p in range(passes):
                    same = [pa.array(np.full(part.num_rows, x, np.int32)) for x in (p, dim)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(strings[:, p]), part.column(0)], ["pass", "dim", "string", "cls"])

    return run


def placed(strings: DataFrame, bits: int, tile: int) -> DataFrame:
    """Rows (pass, dim, cls, tile, run): the tile of each vector's place in the order of its pass, and its leading bits."""
    order = ["pass", "dim", "string", "cls"]
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = cut_lineage(strings.repartitionByRange(*order).sortWithinPartitions(*order).select(*order, F.spark_partition_id().alias("part"), row.alias("row")))
    # One row per partition: the places before it.
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("size")).select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    at = F.floor((F.col("start") + F.col("row")) / tile).cast("int")
    return ordered.join(starts, "part").select("pass", "dim", "cls", at.alias("tile"), F.shiftright("string", STRING - bits).alias("run"))


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest position linked with each of ``n`` positions."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def link_tile(table: pa.Table, cos: float) -> pa.Table:
    """Links of tile ``lo`` with tile ``hi``, and with itself where ``hi`` is the next one: rows (cls, links, root)."""
    table = table.sort_by([("cls", "ascending")])
    cls, n, tile = (table[c].to_numpy() for c in ("cls", "n", "tile"))
    p, low, high = (table[c][0].as_py() for c in ("pass", "lo", "hi"))
    listed = lambda c: table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(cls), -1)
    tiles, runs = listed("tiles"), listed("runs")
    x = matrix(table["vec"])
    x /= np.sqrt((x * x).sum(1))[:, None]
    a, b = np.flatnonzero(tile == low), np.flatnonzero(tile == high)
    found_i, found_j = [], []
    for other in (a, b) if high == low + 1 else (b,):
        for lo in range(0, len(a), 512):
            rows = a[lo : lo + 512]
            i, j = np.nonzero(x[rows] @ x[other].T >= cos)
            i, j = rows[i], other[j]
            if other is a:
                i, j = i[i < j], j[i < j]
            if p and len(i):
                met = (np.abs(tiles[i, :p] - tiles[j, :p]) <= 1) | (runs[i, :p] == runs[j, :p])
                i, j = i[~met.any(1)], j[~met.any(1)]
            found_i.append(i)
            found_j.append(j)
    i, j = (np.concatenate(f) if f else np.zeros(0, int) for f in (found_i, found_j))
    links = np.bincount(i, n[j], len(cls)) + np.bincount(j, n[i], len(cls))
    root = _forest(len(cls), i, j)
    at = np.flatnonzero(links > 0)
    return pa.table({"cls": cls[at], "links": links[at].astype(np.int64), "root": cls[root[at]]})


def near_links(vectors: DataFrame, cos: float = 0.9, window: int = 1000, recall: float = 0.999, tile: int = 1024, seed: int = 11, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Columns id, n_links, component_id, kept for every row."""
    rows = cut_lineage(keyed(vectors, id_col, vec_col).select("id", "k1", "k2", "ok", F.when(F.col("ok"), F.col("vec")).alias("vec")))
    classes = cut_lineage(rows.filter("ok").groupBy("k1", "k2").agg(F.min("id").alias("cls"), F.count(F.lit(1)).alias("n"), F.any_value("vec").alias("vec")))
    bits, passes = plan(classes.count(), cos, window, recall)
    strings = classes.select("cls", "vec").mapInArrow(_strings(passes, seed), "pass int, dim int, string long, cls long")
    home = cut_lineage(placed(strings, bits, tile))
    run = ["pass", "dim", "run"]
    long_runs = home.groupBy(*run).agg(F.min("tile").alias("first"), F.max("tile").alias("last")).filter("last - first >= 2")
    spots = home.groupBy("cls", "dim").agg(F.array_sort(F.collect_list(F.struct("pass", "tile", "run"))).alias("at"))
    each = spots.join(classes.select("cls", "n", "vec"), "cls").select("cls", "n", "vec", "dim", F.col("at.tile").alias("tiles"), F.col("at.run").alias("runs"), F.inline("at"))
    near = each.withColumn("lo", F.explode(F.array("tile", F.col("tile") - 1))).withColumn("hi", F.col("lo") + 1).withColumn("run", F.lit(-1).cast("long"))
    # Long runs are few; a row of theirs goes to one pair of tiles per tile beyond the next.
    far = each.join(long_runs, run).withColumn("other", F.explode(F.sequence("first", "last"))).filter("abs(other - tile) >= 2")
    far = far.withColumn("lo", F.least("tile", "other")).withColumn("hi", F.greatest("tile", "other")).select(*near.columns)
    met = near.unionByName(far).groupBy("pass", "dim", "lo", "hi", "run")
    found = cut_lineage(met.applyInArrow(lambda t: link_tile(t, cos), "cls long, links long, root long"))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("root").alias("a"), F.col("cls").alias("b"))).withColumnRenamed("node", "cls")
    by_class = classes.join(links, "cls", "left").join(labels, "cls", "left").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "cls").alias("component"), F.lit(True).alias("ok"))
    out = rows.select("id", "k1", "k2", "ok").join(by_class, ["k1", "k2", "ok"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
