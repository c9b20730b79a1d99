"""BM25, selection, votes and statistics on small inputs."""

import math
import random

from pyspark.sql import functions as F

from evigraph.functions import constants as K
from evigraph.operators import bm25 as B, dense as D, evaluate as E, retrieve as R, select as C, vote as V


def test_bm25_prefers_the_matching_unit(spark):
    units = spark.createDataFrame([("s", 0, "the killer left by the window"), ("s", 1, "a quiet garden"), ("t", 2, "killer")], "scope string, unit long, text string")
    asks = spark.createDataFrame([("s", 1, "Q", "killer window window"), ("s", 2, "Q", "unheard of")], "scope string, qid long, label string, query string")
    best = B.ranked(B.score_text(units, asks), 8).collect()
    assert [(r.qid, r.unit) for r in best] == [(1, 0)]
    want = 2 * math.log((2 - 1 + 0.5) / 1.5 + 1) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 6 / 4.5))
    assert abs(best[0].score - want) < 1e-6


def test_index_round_trip(spark, tmp_path):
    units = spark.createDataFrame([("s", i, f"word{i % 3} common") for i in range(9)], "scope string, unit long, text string")
    asks = spark.createDataFrame([("s", 1, "Q", "word1 common")], "scope string, qid long, label string, query string")
    a = sorted(map(tuple, B.score(B.build_index(units), asks).collect()))
    b = sorted(map(tuple, B.score_text(units, asks).collect()))
    assert a == b and len(a) == 9


def greedy(scores, k):
    out = []
    for i in sorted(range(len(scores)), key=lambda i: (-scores[i], i)):
        if len(out) < k and all(abs(i - o) > 1 for o in out):
            out.append(i)
    return out


def test_diverse_selection(spark):
    rng = random.Random(2)
    for scores, k in [([1.0, 0.9, 0.8, 0.7, 0.6], 3), ([rng.random() for _ in range(60)], 9), ([0.5] * 12, 4)]:
        rows = spark.createDataFrame([(1, i, s) for i, s in enumerate(scores)], "qid int, unit long, score double")
        got = C.diverse(rows, ["qid"], [F.desc("score"), F.col("unit")], k).first().picked
        assert got == greedy(scores, k)
    assert greedy([1.0, 0.9, 0.8, 0.7, 0.6], 3) == [0, 2, 4]


def test_swap_selection_replaces_weak_neighbours(spark):
    rows = spark.sql("SELECT array(named_struct('unit', 4L, 'score', 1.0D), named_struct('unit', 5L, 'score', 2.0D), named_struct('unit', 9L, 'score', 0.5D), named_struct('unit', 8L, 'score', 0.6D)) AS c")
    assert rows.select(C.diverse_swap("c", 3)).first()[0] == [5, 9]


def votes(spark, letters, methods="abcdefgh"):
    rows = [(1, m, i, x) for i, (m, x) in enumerate(zip(methods, letters))]
    return spark.createDataFrame(rows, "qid int, method string, morder int, selected string")


def test_votes(spark):
    win = lambda letters, tie: V.majority(votes(spark, letters), ["qid"], tie).first().winner
    assert win("ABBB", "a") == "B" and win("ABAB", "b") == "B" and win("ABCD", "c") == "C"
    assert win(["D", None, "x", None], "a") == "D" and win("ABAB", "h") == "A"
    assert V.latest(votes(spark, "ABAB"), ["qid"]).first().winner == "B"
    assert V.latest(votes(spark, ["A", None]), ["qid"]).count() == 0


def test_vote_order_does_not_matter(spark):
    rows = votes(spark, "ABBACBDA")
    a = V.majority(rows, ["qid"], "c").first()
    b = V.majority(rows.orderBy(F.desc("morder")).repartition(3), ["qid"], "c").first()
    assert a == b


def test_exact_p(spark):
    cases = [(0, 0), (15, 8), (16, 9), (3, 15), (63, 29), (1000, 1100), (250000, 251500)]
    rows = spark.createDataFrame(cases, "w long, l long").select("w", "l", E.exact_p("w", "l").alias("p")).collect()
    for r in rows:
        n, k = r.w + r.l, min(r.w, r.l)
        if n <= 3000:
            want = min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0
        else:
            want = math.erfc((abs(r.w - r.l) - 1) / math.sqrt(n) / math.sqrt(2))
        assert abs(r.p - want) < (1e-9 if n <= 3000 else 1e-5), (r, want)


def test_published_intervals(spark):
    row = spark.createDataFrame([(126, 234), (0, 0)], "c int, n int")
    low, high = E.wilson("c", "n")
    got = row.select(low.alias("a"), high.alias("b")).collect()
    assert round(got[0].a, 3) == 0.474 and round(got[0].b, 3) == 0.601 and got[1].a is None


def test_holm_is_monotone_and_capped(spark):
    rows = spark.createDataFrame([("f", m, p) for m, p in zip("abcd", (0.01, 0.04, 0.03, 0.6))], "f string, method string, p double")
    got = {r.method: round(r.holm_p, 6) for r in E.holm(rows, ["f"]).collect()}
    assert got == {"a": 0.04, "c": 0.09, "b": 0.09, "d": 0.6}


def test_average_ranks(spark):
    vals = [5, 1, 5, 9, 1, 5]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v int")
    got = {r.i: r.rk for r in E.average_ranks(rows, "v", "rk", 2.0).collect()}
    want = {i: sum(x < v for x in vals) + (sum(x == v for x in vals) + 1) / 2 for i, v in enumerate(vals)}
    assert got == want


def test_held_out_equals_retraining(spark):
    rng = random.Random(6)
    rows = [(f"n{i % 5}", i, m, o, rng.choice("ABCD"), rng.choice("ABCD")) for i in range(60) for o, m in enumerate("xyz")]
    a = spark.createDataFrame(rows, "novel string, qid int, method string, morder int, selected string, gold string").withColumn("correct", (F.col("selected") == F.col("gold")).cast("int"))
    got = {r.novel: r.method for r in V.best_method_held_out(a.withColumn("qtype", F.lit("t")), False).select("novel", "method").distinct().collect()}
    for g in {r[0] for r in rows}:
        acc = {m: (sum(r[4] == r[5] for r in rows if r[0] != g and r[2] == m) + 2) / (sum(r[0] != g and r[2] == m for r in rows) + 8) for m in "xyz"}
        assert got[g] == max("xyz", key=lambda m: (acc[m], -"xyz".index(m)))


def test_dense_blocks_and_ties(spark, monkeypatch):
    vecs = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(12)], "unit long, vector array<double>")
    qs = spark.createDataFrame([(q, [1.0, float(q)]) for q in range(5)], "qid int, vector array<double>")
    whole = sorted(map(tuple, D.dense_topk(vecs, qs, 3).collect()))
    monkeypatch.setattr(D, "BLOCK", 2)
    assert sorted(map(tuple, D.dense_topk(vecs, qs, 3).collect())) == whole
    assert [r[1] for r in whole if r[0] == 0] == [2, 5, 8]


def test_histogram_keeps_the_right_edge(spark):
    rows = spark.createDataFrame([(1, 0.0), (1, 1.0), (1, 0.999)], "k int, x double")
    got = {r.bin: r.value for r in E.histogram(rows, ["k"], "x", 4).collect()}
    assert got == {0: 1, 1: 0, 2: 0, 3: 2}


def test_bounded_top_equals_full_scoring(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]  # few frequent words, many rare ones
    units = [(s, u, " ".join(rng.choices(words, weights, k=rng.randint(1, 40)))) for s in "ab" for u in range(300)]
    units += [("a", 1000 + i, "w0 w1 w40") for i in range(30)] + [("c", 1, "w0"), ("c", 2, ""), ("c", 3, None)]
    asks = [(s, q, x, " ".join(rng.choices(words, k=rng.randint(1, 6)))) for s in "abc" for q in range(12) for x in "QA"]
    asks += [("a", 90, "Q", "w0 w1 w40"), ("a", 91, "Q", "w0"), ("a", 92, "Q", "unheard"), ("a", 93, "Q", None), ("d", 94, "Q", "w0")]
    units = spark.createDataFrame(units, "scope string, unit long, text string")
    asks = spark.createDataFrame(asks, "scope string, qid long, label string, query string")
    for k in (1, 3, 25):
        got = sorted(map(tuple, B.top_text(units, asks, k).select("scope", "qid", "label", "unit", "rank", F.round("score", 8)).collect()))
        want = sorted(map(tuple, B.ranked(B.score_text(units, asks), k).select("scope", "qid", "label", "unit", "rank", F.round("score", 8)).collect()))
        assert got == want and want


def test_term_bounds_hold(spark):
    rng = random.Random(8)
    rows = [("s", t, u, rng.random()) for t in "xyz" for u in rng.sample(range(500), 200)] + [("s", "few", u, 1.0) for u in range(3)]
    got = {r.term: r for r in B.term_bounds(spark.createDataFrame(rows, "scope string, term string, unit long, weight double"), 5).collect()}
    for t in "xyz":
        own = sorted((r[3] for r in rows if r[1] == t), reverse=True)
        assert got[t].high == own[0] and 0 < got[t].kth <= own[4]
    assert got["few"].kth == 0


def test_planned_top_equals_scoring_every_node(spark):
    rng = random.Random(5)
    kinds = ["person", "clue", "place", "other"]
    nodes = [(g, f"n{i:03d}", f"name{i % 50}", rng.choice(kinds), rng.choice([None, 1, 2, 3, 5])) for g in (1, 2) for i in range(80)]
    scores = [(g, q, x, f"n{rng.randrange(80):03d}", rng.random() * 3) for g in (1, 2) for q in range(6) for x in ("question", "terms") for _ in range(4)]
    targets = [(g, q, f"name{rng.randrange(60)}") for g in (1, 2) for q in range(8)]
    weights = {"question": 1.0, "terms": 1.2}
    got = R.planned_top(
        spark.createDataFrame(nodes, "graph_id int, node_id string, name string, type string, salience int"),
        spark.createDataFrame(scores, "graph_id int, qid int, label string, node_id string, score double"), weights,
        spark.createDataFrame(targets, "graph_id int, qid int, name string"), 8,
    ).collect()
    want = []
    for g, q in {(t[0], t[1]) for t in targets}:
        every = []
        for n in (n for n in nodes if n[0] == g):
            text = sum(s[4] * weights[s[2]] for s in scores if s[:2] == (g, q) and s[3] == n[1])
            named = 3.0 * sum(t[:2] == (g, q) and t[2] == n[2] for t in targets)
            every.append((-round((text + named) * K.TYPE_BOOST.get(n[3], 1.0) + 0.4 * max((3 if n[4] is None else n[4]) - 1, 0), 9), n[1]))
        want += [(g, q, n, i + 1, -s) for i, (s, n) in enumerate(sorted(every)[:8])]
    assert sorted((r.graph_id, r.qid, r.node_id, r.rank) for r in got) == sorted(w[:4] for w in want)


def test_best_units_equal_full_scoring(spark, monkeypatch):
    """Slices, blocks, ties, frequent and rare terms, scopes of two types: the rows of full scoring, in fewer rows."""
    monkeypatch.setattr(B, "SLICE", 3000)
    monkeypatch.setattr(B, "ASKED", 16)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choice(words[: rng.choice((3, 10, 40))]) for _ in range(n))
    units = spark.createDataFrame([(i % 3, f"u{i}", text(rng.randint(0, 14))) for i in range(2400)], "scope int, unit string, text string")
    rows = [(i % 4, i, x, text(rng.randint(0, 5)) + " unheard") for i in range(40) for x in "QA"]
    asks = spark.createDataFrame(rows, "scope long, qid long, label string, query string")
    pick = lambda df: sorted(map(tuple, df.select("scope", "qid", "label", "unit", "rank", F.round("score", 8)).collect()))
    for k in (1, 8):
        assert pick(B.best_of_text(units, asks, k)) == pick(B.ranked(B.score_text(units, asks), k))


def test_first_nodes_make_no_row_per_question_and_node(spark):
    """Full scoring puts every pair of a question and a node that share a word through a shuffle."""
    units = spark.createDataFrame([(0, i, f"common word{i}") for i in range(3000)], "scope int, unit long, text string")
    asks = spark.createDataFrame([(0, i, "Q", f"common word{i}") for i in range(200)], "scope int, qid long, label string, query string")
    best = B.best_of_text(units, asks, 2)
    plan = best._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and best.count() == 400

def test_own_vocabulary_and_counts_without_postings(spark):
    """A scope's own terms in its rows give the same scores as a join; counts and scores of all terms shuffle no row per token."""
    import itertools

    rng = random.Random(3)
    words = ["a", "b", "cd", "e9", "漢", "zz", "killer", "key"]
    rows = [(s, s * 100 + u, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 30])))) for s in range(4) for u in range(6)] + [(9, 900, None), (9, 901, "...")]
    units = spark.createDataFrame(rows, "scope long, unit long, text string")
    asks = spark.createDataFrame([(s, s, x, " ".join(rng.choices(words, k=3)) + " nowhere") for s, x in itertools.product(range(4), "QA")], "scope long, qid long, label string, query string")
    only = B.text_vocabulary(asks).groupBy("scope").agg(F.collect_list("term").alias("only"))
    pick = lambda df: sorted((r.scope, r.qid, r.label, r.unit, round(r.score, 9)) for r in df.collect())
    with_own = units.join(only, "scope", "left").withColumn("only", F.coalesce("only", F.array().cast("array<string>")))
    full = pick(B.score(B.build_index(units), asks))
    assert pick(B.score_text(units, asks)) == full and pick(B.score_text(with_own, asks)) == full and len(full) > 20
    index = B.build_index(units)
    want = {}
    for s, u, t in rows:
        for w in (t or "").split():
            if w != "...":
                want.setdefault((s, w), []).append(u)
    assert {(r.scope, r.term): (r.df, r.cf) for r in index.terms.collect()} == {k: (len(set(v)), len(v)) for k, v in want.items()}
    plan = index.terms._jdf.queryExecution().executedPlan().toString()
    assert "unit" not in plan.split("Exchange hashpartitioning(")[1].split(")")[0] and all("unit" not in x.split(")")[0] for x in plan.split("Exchange hashpartitioning(")[1:])


def test_slices_score_few_blocks(monkeypatch):
    """The best units of a slice by bounds equal those of full scoring, with few units scored; ties go to the smaller unit."""
    import numpy as np

    rng = np.random.default_rng(4)
    n_units, n_terms = 20_000, 60
    pairs = np.unique(np.stack([np.repeat(np.arange(n_units), 6), rng.integers(0, n_terms, 6 * n_units)], axis=1), axis=0)
    weight = rng.choice([0.5, 1.0, 2.0], len(pairs)) * (1 + pairs[:, 1] % 7)
    rng.shuffle(order := np.arange(len(pairs)))
    part = B._Slice(pairs[order, 0], pairs[order, 1], weight[order], n_units, n_terms)
    scored, plain = [], part.scores
    monkeypatch.setattr(part, "scores", lambda blocks: scored.append(len(blocks) * B.STRIDE) or plain(blocks))
    for k in (1, 8, 40):
        for _ in range(30):
            terms = rng.choice(n_terms, 5, replace=False)
            factors = rng.choice([1.0, 0.7, 2.4], 5)
            full = np.zeros((n_units, n_terms))
            full[pairs[:, 0], pairs[:, 1]] = weight
            total = np.floor(full[:, terms] @ factors * 1e9 + 0.5)
            want = np.lexsort((np.arange(n_units), -total))[:k]
            unit, score = part.best(terms.tolist(), factors.tolist(), k)
            assert unit.tolist() == want.tolist() and np.floor(score * 1e9 + 0.5).tolist() == total[want].tolist()
    assert sum(scored) < 90 * n_units / 2
    assert len(part.best([], [], 8)[0]) == 0


def test_texts_are_cut_into_terms_once(spark):
    """Weights of dear texts equal those of the plain index, also for empty texts, and read each text a single time."""
    rng = random.Random(8)
    rows = [(i % 3, f"u{i}", None if i % 17 == 0 else " ".join(rng.choices(["a", "b", "cd", "e9", "漢", "zz"], k=i % 9))) for i in range(200)]
    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda t: seen.add(1) or t, "string").asNondeterministic()
    units = spark.createDataFrame(rows, "scope int, unit string, text string")
    words = spark.createDataFrame([(s, w) for s in range(4) for w in ("a", "cd", "漢", "none")], "scope int, term string")
    pick = lambda df: sorted((r.scope, r.term, r.unit, round(r.weight, 9)) for r in df.collect())
    assert pick(B.text_weights(units.withColumn("text", count("text")), words)) == pick(B.weighted(B.build_index(units, words)))
    assert seen.value == len(rows)


def test_two_stage_draws_are_hashed_in_lots_and_dealt_out(spark, monkeypatch):
    """Every row of every draw by its hash, as one by one; numbers of many digits; the draws' blocks fill several tasks."""
    import hashlib

    import numpy as np

    from evigraph.operators import evaluate as E

    head = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:8], 16)
    for draw, slot, j in ((0, 0, 7), (9999, 12, 4095), (10**17, 10**17, 10**17), (12345, 678901234567, 10**18)):
        many = [np.full(3, x, np.int64) for x in (draw, slot, j)]
        assert E._row_hashes(*many).tolist() == [head(f"row:{draw}:{slot}:{j}")] * 3
    monkeypatch.setattr(E, "BLOCK", 50)
    monkeypatch.setattr(E, "HASHED", 64)
    values = {"a": [1] * 70 + [-1] * 30 + [0] * 37, "b": [-1, 0], "c": [1] * 12}
    rows = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "novel string, value int")
    order, draws = sorted(values, key=lambda g: hashlib.md5(g.encode()).hexdigest()), 40
    means = []
    for d in range(draws):
        total = count = 0
        for slot in range(3):
            v = values[order[head(f"seed:{d}:{slot}") % 3]]
            n, neg, pos = len(v), v.count(-1), v.count(1)
            hits = [head(f"row:{d}:{slot}:{j}") % n for j in range(n)]
            total += sum(-1 if r < neg else 1 if r < neg + pos else 0 for r in hits)
            count += n
        means.append(total / count)
    means.sort()
    seen = []
    keep = E.interval
    monkeypatch.setattr(E, "interval", lambda df, n: seen.append(df) or keep(df, n))
    got = E.two_stage_bootstrap(rows, "novel", draws).first()
    assert (round(got.low, 12), round(got.high, 12)) == (round(means[int(0.025 * draws)], 12), round(means[int(0.975 * draws)], 12))
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "REPARTITION_BY_NUM" in plan
