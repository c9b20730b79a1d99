"""Suffix dedup, Jaccard join, near vectors and curve search against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest

from evigraph.llm import common, hilbert_search, jaccard_join, near_vectors, suffix_dedup
from pyspark.sql import functions as F


def reach(nodes, links):
    label = {n: n for n in nodes}

    def root(n):
        while label[n] != n:
            label[n] = label[label[n]]
            n = label[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def spans_of(rows, least):
    """Removed byte runs by document, by looking at every window."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        runs = []
        for p in range(len(raw) - least + 1):
            w = raw[p : p + least]
            if w in seen:
                if runs and runs[-1][1] >= p:
                    runs[-1][1] = p + least
                else:
                    runs.append([p, p + least])
            seen.add(w)
        out[i] = runs
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeéñ漢") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(40) for _ in range(4)]
    rows = [None, "", "a", "short text", "ab" * 3000, "x" * 99, "x" * 100, "x" * 101, "abc" * 40 + "q" + "abc" * 60]
    for _ in range(60):
        body = prose(rng.randint(5, 120)).split()
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(body))
            body[at:at] = rng.choice(shared).split()[rng.randint(0, 9) : rng.randint(25, 40)]
        rows.append(" ".join(body))
    for t in rows[9:40]:
        if t:
            w = t.split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w))
    rows += rows[9:16] + [rows[12]] * 20 + [prose(20000)]
    return [(i, t) for i, t in enumerate(rng.sample(rows, len(rows)))]


@pytest.mark.parametrize("parts", [1, 5])
def test_suffix_dedup_matches_every_window(make_docs, texts, parts, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1 << 14)
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(make_docs(texts, parts), keep=("source", "spans")).collect()}
    want = spans_of(texts, 100)
    for i, text in texts:
        raw, runs = (text or "").encode(), want[i]
        kept = b"".join(raw[x:y] for x, y in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(raw)]))
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], bytes(got[i]["kept"])) == (len(raw), len(raw) - len(kept), len(runs), kept)


def test_suffix_dedup_of_equal_rows_and_null_ids(make_docs):
    text = "the quick brown fox " * 3 + "".join(map(chr, range(200, 330)))
    rows = suffix_dedup.remove_repeats(make_docs([(None, text), (None, text), (4, text), (4, text), (5, text + "z")]))
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in rows.collect()) == [(-1, 0), (-1, 0), (4, len(text.encode())), (4, len(text.encode())), (5, len(text.encode()))]
    assert suffix_dedup.remove_repeats(make_docs([(1, text)]).limit(0)).count() == 0


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80), (2, 60)])
def test_jaccard_join_matches_all_pairs(make_docs, texts, words, percent):
    rows = texts + [(900, "a b c"), (901, "A b\tC"), (902, "a b"), (903, "b a"), (904, "a  b")]
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + min(words, len(w))]) for j in range(max(1, len(w) - words + 1))} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) > 0]
    want = reach(sets, links)
    got = jaccard_join.near_sets(make_docs(rows), words, percent, tile=3).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(sets[i]), want[i]) for i in sets}
    assert links and len(got) == len(rows)


def test_jaccard_join_of_a_dense_group(make_docs):
    """Copies around the threshold: chains, and pairs that only the second round sees."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = f"v{rng.randrange(30)}"
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[j : j + 3]) for j in range(58)} for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    want = reach(sets, links)
    got = jaccard_join.near_sets(make_docs(rows), 3, 90, tile=16).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and 1 < len(set(want.values())) < 150


def test_jaccard_join_of_null_and_repeated_ids(make_docs):
    t, u = "one two three four five six", "seven eight nine ten eleven twelve"
    got = jaccard_join.near_sets(make_docs([(None, t), (3, t), (3, u), (7, u), (8, None), (None, None)]), 3, 90).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in got) == [(-1, 0, -1), (-1, 4, -1), (3, 4, 3), (3, 4, 3), (7, 4, 3), (8, 0, 8)]
    assert jaccard_join.near_sets(make_docs([(1, t)]).limit(0)).count() == 0


def test_boundary_is_the_cheapest():
    sizes = {5: 100, 15: 50, 60: 30, 200: 10}
    assert jaccard_join.boundary(sizes, 0.0, 90) < jaccard_join.boundary(sizes, 50.0, 90) == 200


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("vec", F.lit(1)).withColumn("label", F.lit("x")).withColumn("id", F.col("vec_id") + 1).drop("id").repartition(3)


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    near = x[:60] + rng.normal(scale=0.12, size=(60, 16)).astype(np.float32)
    dense = x[7] + rng.normal(scale=0.2, size=(120, 16)).astype(np.float32)
    rows = [v.tolist() for v in np.concatenate([x, near, dense, x[:5], np.repeat(x[9:10], 30, 0), 2 * x[3:4]])]
    rows += [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0], [1.0, 2.0]]
    return list(enumerate(rows))


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_near_vectors_match_all_pairs(spark, points):
    good = {i: np.array(np.array(v, np.float32), float) for i, v in points if usable(v)}
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.9 * np.sqrt((good[a] @ good[a]) * (good[b] @ good[b])) - 1e-15]
    want, n = reach([i for i, _ in points], links), defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    got = near_vectors.near_links(vectors(spark, points), window=20, recall=1 - 1e-9, tile=16).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {i: (n[i], want[i], want[i] == i) for i, _ in points}


def test_near_vectors_of_null_ids(spark):
    got = near_vectors.near_links(vectors(spark, [(None, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0])])).collect()
    assert sorted(((r["vec_id"] or -1), r["n_links"], r["component_id"] or -1) for r in got) == [(-1, 0, -1), (4, 1, 4), (4, 1, 4)]
    assert near_vectors.near_links(vectors(spark, [(1, [1.0])]).limit(0)).count() == 0


def test_hilbert_curve_is_continuous():
    side = np.arange(16)
    cells = np.stack([c.ravel() for c in np.meshgrid(side, side, side)], 1)
    order = np.argsort(hilbert_search.hilbert_keys(cells, 4))
    assert sorted(hilbert_search.hilbert_keys(cells, 4)) == list(range(16**3))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


def test_search_recall_and_ties(spark, points):
    good = {i: np.array(np.array(v, np.float32), float) for i, v in points if usable(v) and len(v) == 16}
    got = defaultdict(list)
    for r in hilbert_search.search(vectors(spark, points), F.col("id") % 20 == 0, k=10, tile=64).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    hits = total = 0
    for q in [i for i in good if i % 20 == 0]:
        want = sorted(((-(good[q] @ good[i]), i) for i in good if i != q))[:10]
        assert len(got[q]) == 10 and got[q] == sorted(got[q], key=lambda x: (-x[1], x[0])) and q not in dict(got[q])
        assert all(s == pytest.approx(good[q] @ good[i]) for i, s in got[q])
        hits += len({i for _, i in want} & set(dict(got[q])))
        total += 10
    assert hits / total >= 0.9
    assert set(got) == {i for i in good if i % 20 == 0}


def test_search_of_few_rows(spark):
    got = hilbert_search.search(vectors(spark, [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.0, 1.0]), (5, None)]), F.col("id") % 20 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(0, 1, 20, 1.0), (0, 2, 3, 0.0), (20, 1, 0, 1.0), (20, 2, 3, 0.0)]
    assert hilbert_search.search(vectors(spark, [(0, [1.0])]).limit(0), F.col("id") % 20 == 0).count() == 0


def test_levels_keep_every_key():
    rng, levels, all_keys = np.random.default_rng(0), common.Levels(), set()
    for _ in range(50):
        keys = np.setdiff1d(rng.integers(0, 1 << 20, rng.integers(0, 200)).astype(np.uint64), np.array(sorted(all_keys), np.uint64))
        levels.add(keys)
        all_keys |= set(keys.tolist())
        probe = rng.integers(0, 1 << 20, 500).astype(np.uint64)
        assert levels.find(probe).tolist() == [p in all_keys for p in probe.tolist()]
        assert len(levels.runs) <= 14
