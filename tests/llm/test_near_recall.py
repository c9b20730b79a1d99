"""Measured link recall of the sorted passes at the production recall, and windows across the borders of runs."""

import numpy as np

from evigraph.llm import near_vectors


def test_link_recall_of_passes(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 16))
    pairs = [v / np.linalg.norm(v) for v in x]
    other = [v + 0.46 * (d - (d @ v) * v) / np.linalg.norm(d - (d @ v) * v) for v, d in zip(pairs, rng.normal(size=(500, 16)))]  # cosine 0.908
    rows = np.array([*pairs, *other], np.float32)
    bits = near_vectors.plan(len(rows), 0.9, 20, 0.999)[0]
    unit = rows.astype(float) / np.linalg.norm(rows.astype(float), axis=1)[:, None]
    links = int((np.triu(unit @ unit.T, 1) >= 0.9).sum())
    got = near_vectors.near_links(spark.createDataFrame(list(enumerate(rows.tolist())), "vec_id long, embedding array<float>").repartition(3), window=20, tile=32)
    found = sum(r["n_links"] for r in got.collect()) // 2
    print("bits", bits, "links", links, "found", found)
    assert bits > 0 and links >= 500 and 0.99 * links <= found <= links


def linked(spark, rows, **how):
    got = near_vectors.near_links(spark.createDataFrame(list(enumerate(rows.tolist())), "vec_id long, embedding array<double>").repartition(3), **how)
    return {r["vec_id"]: r["n_links"] for r in got.collect()}


def test_neighbours_across_runs_meet(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 8))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = {i: int(c) - 1 for i, c in enumerate((unit @ unit.T >= 0.9 - 1e-12).sum(1))}
    assert near_vectors.plan(300, 0.9, 4, 0.2)[0] == 6
    # one tile holds the whole order, so every pair is in some window although the leading bits differ
    assert linked(spark, x, window=4, recall=0.2, tile=400) == want


def test_long_runs_meet_whole(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([np.ones((120, 8)) + rng.normal(size=(120, 8)) * 1e-6, rng.normal(size=(40, 8))])
    got = linked(spark, x, window=10, tile=8)
    assert all(got[i] >= 119 for i in range(120))
