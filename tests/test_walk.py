"""Ranks in blocks, as wide rows and by plain loops; names in texts; tokenising once."""

import random
import re

import pytest
from pyspark.sql import functions as F

from evigraph.operators import bm25 as B, graph as G, iterate as I, retrieve as R, walk


def plain(nodes, edges, asks, named, weights, rounds=16, alpha=0.78):
    """(graph, question, node) -> rank by loops; ``weights`` {(graph, term): {node: weight}}."""
    out = {}
    for (g, q), texts in asks.items():
        mine = [n for x, n in nodes if x == g]
        seed = dict.fromkeys(mine, 0.0)
        for label, text in texts:
            score = dict.fromkeys(mine, 0.0)
            for t in set(text.split()):
                for n, w in weights.get((g, t), {}).items():
                    score[n] += w
            best = max(score.values())
            for n in mine:
                if best > 0:
                    seed[n] = max(seed[n], (0.45 if label == "Q" else 0.30) * score[n] / best)
        for n in named.get((g, q), ()):
            seed[n] += 1.0
        total = sum(seed.values())
        seed = {n: s / total if total else 1 / len(mine) for n, s in seed.items()}
        links = {n: [] for n in mine}
        for x, a, b, w in edges:
            if x == g and a in links and b in links:
                links[a].append((b, w))
                links[b].append((a, w))
        rank = dict(seed)
        for _ in range(rounds):
            stuck = sum(rank[n] for n in mine if not links[n])
            new = {n: (1 - alpha + alpha * stuck) * seed[n] for n in mine}
            for n in mine:
                t = sum(w for _, w in links[n])
                for m, w in links[n]:
                    new[m] += alpha * rank[n] * w / t
            rank = new
        out |= {(g, q, n): r for n, r in rank.items() if r > 0}
    return out


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(4)
    nodes, edges, units, asks = [], [], [], []
    for g in range(9):
        size = 60 if g == 0 else rng.randint(1, 12)
        names = [f"n{i}" for i in range(size)]
        nodes += [(g, n) for n in names]
        units += [(g, n, " ".join(rng.choice(["red", "blue", "key", "door", "man"]) for _ in range(rng.randint(0, 6)))) for n in names]
        for _ in range(rng.randint(0, 3 * size)):
            edges.append((g, rng.choice(names), rng.choice([*names, "gone"]), rng.random() + 0.1, "supports", "said"))
        if g == 0:
            edges += [(g, "n0", n, 0.7, "related_to", "said") for n in names]  # a hub, linked with itself too
        for q in range(rng.randint(0, 11) if g else 13):
            asks += [(g, 100 * g + q, "Q", rng.choice(["red key", "the man", "nothing", ""])), (g, 100 * g + q, "A", rng.choice(["blue", "red door", "none"]))]
    named = [(g, q, n) for g, q, label, _ in asks if label == "Q" for n in [rng.choice([x for y, x in nodes if y == g])] if rng.random() < 0.3]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {
        "nodes": make(nodes, "graph_id int, node_id string"), "units": make(units, "scope int, unit string, text string"),
        "edges": make(edges, "graph_id int, src string, dst string, confidence double, type string, evidence string"),
        "asks": make(asks, "scope int, qid long, label string, query string"), "mentions": make(named, "graph_id int, qid long, node_id string"),
    }


def expected(world):
    index = B.build_index(world["units"], B.text_vocabulary(world["asks"]))
    weights, asks, named = {}, {}, {}
    for r in B.weighted(index).collect():
        weights.setdefault((r.scope, r.term), {})[r.unit] = r.weight
    for r in world["asks"].collect():
        asks.setdefault((r.scope, r.qid), []).append((r.label, r["query"]))
    for r in world["mentions"].collect():
        named.setdefault((r.graph_id, r.qid), []).append(r.node_id)
    edges = [tuple(r) for r in world["edges"].select("graph_id", "src", "dst", R.transition_weight()).collect()]
    return plain([tuple(r) for r in world["nodes"].collect()], edges, asks, named, weights)


@pytest.mark.parametrize("graph_rows,bin_rows,cells", [(10**6, 10**6, 10**6), (10**6, 40, 100), (150, 10**6, 10**6), (0, 10**6, 10**6)])
def test_ranks_in_blocks_and_as_rows(spark, world, monkeypatch, graph_rows, bin_rows, cells):
    """All graphs in one bin; many bins and blocks; the hub's graph as rows; all graphs as rows."""
    real = walk.question_ranks
    monkeypatch.setattr(walk, "question_ranks", lambda *a, **k: real(*a, cells=cells, bin_rows=bin_rows))
    got = R.graph_ranks(world["nodes"], world["edges"], world["units"], world["asks"], world["mentions"], graph_rows=graph_rows)
    got = {(r.graph_id, r.qid, r.node_id): r["rank"] for r in got.collect()}
    want = expected(world)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_rows_with_a_split_hub_and_large_numbers(spark, world):
    edges = world["edges"].filter("graph_id = 0").select("graph_id", "src", "dst", R.transition_weight().alias("weight"))
    seeds = spark.createDataFrame([(0, 7, "n0", 0.25), (0, 7, "n5", 0.75), (0, 9, "n3", 1.0)], "graph_id int, qid int, node_id string, seed double")
    one, many = (I.personalized_rank(edges, seeds, ["graph_id"], 0.78, 6, block_edges=b).collect() for b in (10**6, 3))
    key = lambda rows: {(r.qid, r.node_id): r["rank"] for r in rows}
    one, many = key(one), key(many)
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-12 for k in one)


def test_dense_numbers(spark):
    rows = I.numbered(spark.range(1000).repartition(17).filter("id % 7 > 2")).collect()
    assert sorted(r.n for r in rows) == list(range(len(rows)))


def test_names_as_runs_of_words(spark):
    names = ["red key", "Red-Key", "key", "#12", "a.b c", "漢字", "Brand#1", "o'neil's", "x", "(odd) name!", "the man", "key key", "é12"]
    texts = ["a red key fits", "red-key", "Brand#1 and brand #1", "say a.b c now", "漢字 here", "o'neil's the  man", "(odd) name! odd name", "the odd name", "key key key", "monkey", "né12 é12", "#12#123", ""]
    nodes = spark.createDataFrame([(1, str(i), n, "") for i, n in enumerate(names)], "graph_id int, node_id string, name string, alias string")
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)] + [(2, 99, "red key")], "graph_id int, qid int, text string")
    got = {(r.qid, int(r.node_id)) for r in G.name_mentions(nodes, rows).collect()}
    norm = lambda s: " ".join(s.lower().split())
    want = {(q, i) for q, t in enumerate(texts) for i, n in enumerate(names) if len(norm(n)) >= 3 and re.search(rf"(?<![a-z0-9]){re.escape(norm(n))}(?![a-z0-9])", norm(t))}
    assert got == want and len(want) > 12


def test_statistics_count_units_without_words(spark):
    units = spark.createDataFrame([("s", 1, "a b c a"), ("s", 2, ""), ("s", 3, None), ("t", 4, "...")], "scope string, unit long, text string")
    vocabulary = spark.createDataFrame([("s", "a"), ("t", "q")], "scope string, term string")
    for index in (B.build_index(units), B.build_index(units, vocabulary)):
        assert {r.scope: (r.n, r.avgdl) for r in index.stats.collect()} == {"s": (3, 4 / 3), "t": (1, 0.0)}
        assert {(r.term, r.df) for r in index.terms.collect()} >= {("a", 1)} and index.postings.filter("term = ''").count() == 0
