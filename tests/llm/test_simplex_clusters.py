"""Clusters in whole numbers against plain loops; bounds of the projection."""

import hashlib
import math
import random

import numpy as np
import pytest

from evigraph.llm import simplex_clusters as sc


def brute(rows, k=8, rounds=10, width=64):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) and abs(1024 * x) <= sc.LIMIT for x in v)]
    code = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    centres = [q for _, q in sorted(kept, key=lambda r: (code(r[0]), r[1]))[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(near(q)[1], []).append(q)
        centres = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if j in groups else c for j, c in enumerate(centres)]
    last = [(i, *near(q)[::-1]) for i, q in kept]
    inertia = {j: sum(d for _, c, d in last if c == j) for j in range(len(centres))}
    text = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    return sorted((str(i), c, d, inertia[c], sum(inertia.values()), text(centres[c])) for i, c, d in last)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "x", [2], 3) for r in rows], "vec_id long, embedding array<double>, cluster int, q string, apex array<int>, `a.b` int").repartition(parts)


def got(df):
    rows = df.withColumn("code", sc.centroid_digest(df["centroid"])).collect()
    return sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["code"]) for r in rows)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    middle = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    out = [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(middle)]) for i in range(150)]
    out += [(1000 + i, out[3][1]) for i in range(60)]  # many copies
    out += [(5, out[9][1]), (None, out[10][1]), (None, out[11][1]), (7, out[7][1])]
    out += [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [float("nan")] + [0.0] * 63), (2004, [float("inf")] + [0.0] * 63), (2005, [None] + [0.0] * 63)]
    out += [(2006, [1e30] + [0.0] * 63), (2007, [0.0] * 64), (2008, [-1e5] * 64), (2009, [-1e-9] * 64), (2010, [2000.5] * 64)]
    return out


def test_matches_plain_loops(spark, rows):
    assert got(sc.cluster(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize("pivots", [1, 3, 20])
def test_any_number_of_pivots(spark, rows, pivots):
    assert got(sc.cluster(frame(spark, rows), pivots=pivots, rounds=4, k=5)) == brute(rows, 5, 4)


def test_ties_few_vectors_and_none(spark):
    same = [(i, [0.5] * 64) for i in range(12)]  # centroids coincide: the smallest number wins, the others stay
    assert got(sc.cluster(frame(spark, same))) == brute(same)
    few = [(1, [0.0] * 64), (2, [1.0] * 64), (3, [0.5] * 64)]
    assert got(sc.cluster(frame(spark, few))) == brute(few)
    assert sc.cluster(frame(spark, [(1, [1.0] * 3)])).count() == 0 and sc.cluster(frame(spark, few).limit(0)).columns[0] == "vec_id"


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(2)
    middle = rng.normal(0, 900, (8, 64))
    q = np.floor(middle[rng.integers(0, 8, 2000)] + rng.normal(0, 60, (2000, 64))).astype(np.int64)
    simplex = sc.Simplex(np.vstack([q[:6], q[:2], np.zeros((1, 64), np.int64)]))
    assert len(simplex.pivots) == 7  # repeated pivots are left out
    centres = np.floor(middle).astype(np.int64)
    low, high = sc.bounds(simplex.apex(q), simplex.apex(centres))
    true = ((q[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (low <= true).all() and (true <= high).all()
    cluster, distance, compared = sc.nearest(q, simplex.apex(q), centres, simplex.apex(centres))
    assert (distance == true.min(axis=1)).all() and (cluster == true.argmin(axis=1)).all()
    assert compared < 0.5 * true.size
