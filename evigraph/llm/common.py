"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: White space of the word contracts: space and the bytes 09 to 0D. ``bytes.split`` cuts at the same ones.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, parts: int) -> Column:
    """Fold of a row: crc32 of the key as text, modulo ``parts``. A null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts


def whole_id(df: DataFrame, name: str) -> Column:
    """The id column as a long. Ids of other types are refused by name: these operators order ids as numbers."""
    kind = df.schema[name].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise TypeError(f"column {name} must hold whole numbers, not {kind}")
    return F.col(name).cast("long")


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit keys; a bijection."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
_TURN = [np.uint64(x) for x in (32, 29, 31)]


def chain(words: list[np.ndarray]) -> np.ndarray:
    """Hash of word sequences (one array per place), one word after the other."""
    h = words[0] * _ODD[0]
    for i, w in enumerate(words[1:]):
        h ^= h >> _TURN[i % 3]
        h += w
        h *= _ODD[(i + 1) % 4]
    return mix(h)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


class Levels:
    """Logarithmic family of sorted key runs.

    Each ``add`` brings a new sorted run; runs of equal size class merge, so there are at most
    log2(rows) runs and each key is merged at most that often. ``find`` looks a batch up in all of
    them by binary search.
    """

    def __init__(self) -> None:
        self.runs: list[tuple[np.ndarray, ...]] = []

    def find(self, keys: np.ndarray) -> np.ndarray:
        hit = np.zeros(len(keys), bool)
        for run in self.runs:
            at = np.searchsorted(run[0], keys)
            at[at == len(run[0])] = 0
            hit |= run[0][at] == keys
        return hit

    def add(self, *columns: np.ndarray) -> None:
        """Columns of new rows, sorted by the first; the first one's values are not in any run yet."""
        if not len(columns[0]):
            return
        self.runs.append(columns)
        while len(self.runs) > 1 and len(self.runs[-2][0]) < 2 * len(self.runs[-1][0]):
            b, a = self.runs.pop(), self.runs.pop()
            both = [np.concatenate(x) for x in zip(a, b)]
            order = np.argsort(both[0], kind="stable")
            self.runs.append(tuple(x[order] for x in both))

    def merged(self) -> tuple[np.ndarray, ...]:
        both = [np.concatenate(x) for x in zip(*self.runs)]
        order = np.argsort(both[0], kind="stable")
        return tuple(x[order] for x in both)


def slices(sizes: Iterator[int], limit: int) -> Iterator[tuple[int, int]]:
    """Cut rows into runs whose sizes sum up to ``limit`` or that hold one row."""
    start = total = at = 0
    for at, n in enumerate(sizes):
        if at > start and total + n > limit:
            yield start, at
            start, total = at, 0
        total += n
    if total or at >= start:
        yield start, at + 1


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) of all ends of (a, b): the smallest node reachable.

    Each round gives every node the smallest of itself and its neighbours, then links those labels
    instead: the graph shrinks until no link is left. Rounds are written to the shared folder, so no
    graph ever meets in one place, and a hub is an aggregate followed by a plain join.
    """
    from evigraph.common import cut_lineage

    links = cut_lineage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    labels = nodes.select("node", F.col("node").alias("component"))
    while not links.isEmpty():
        down = links.groupBy("b").agg(F.min("a").alias("best")).withColumnRenamed("b", "at")
        links = cut_lineage(
            links.join(down.select(F.col("at").alias("a"), F.col("best").alias("x")), "a", "left")
            .join(down.select(F.col("at").alias("b"), F.col("best").alias("y")), "b")
            .select(F.coalesce("x", "a").alias("x"), "y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .filter("a < b")
            .distinct()
        )
        labels = cut_lineage(labels.join(down, labels["component"] == down["at"], "left").select("node", F.coalesce("best", "component").alias("component")))
    return labels
