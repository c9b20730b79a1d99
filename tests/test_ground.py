"""Containment, location and repair against brute force."""

import random
import re

from pyspark.sql import functions as F

from evigraph.operators import ground as G
from evigraph.operators import ground as G, retrieve as R, segment as S


def sample(rng, n, length):
    return ["".join(rng.choice("ab c") for _ in range(rng.randint(1, length))) for _ in range(n)]


def test_containment_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    hay = [(k, i, t) for k in ("x", "y") for i, t in enumerate(sample(rng, 30, 60))]
    cuts = [(k, i, t[s : s + rng.randint(1, 40)]) for i, (k, _, t) in enumerate(hay) for s in [rng.randint(0, max(len(t) - 1, 0))]]
    needles = [(k, i, t) for k, i, t in cuts + [("y", 900 + i, t) for i, t in enumerate(sample(rng, 20, 20))] if t]
    want = {(k, n, h) for k, n, t in needles for kk, h, b in hay if k == kk and t in b}
    nd = spark.createDataFrame(needles, "k string, n int, needle string")
    hd = spark.createDataFrame(hay, "k string, h int, body string")
    for limit in (0, 1 << 30):  # all by blocks, all direct
        monkeypatch.setattr(G, "DIRECT", limit)
        rows = G.contained_pairs(nd, hd, ["k"], "needle", "body").select("k", "n", "h").collect()
        assert len(rows) == len(want) and {tuple(r) for r in rows} == want
    every = {(n, kk, h) for k, n, t in needles for kk, h, b in hay if t in b}
    rows = G.contained_pairs(nd.drop("k"), hd, [], "needle", "body").select("n", "k", "h").distinct().collect()
    assert {tuple(r) for r in rows} == every


def test_intervals_equal_brute_force(spark):
    rng = random.Random(8)
    make = lambda n: [(1, i, s, s + rng.randint(1, 300)) for i in range(n) for s in [rng.randint(0, 2000)]]
    left, right = make(40), make(40)
    want = {(a[1], b[1]) for a in left for b in right if a[2] < b[3] and a[3] > b[2]}
    out = G.interval_overlaps(
        spark.createDataFrame(left, "doc int, a int, l_start int, l_end int"), spark.createDataFrame(right, "doc int, b int, r_start int, r_end int"), ["doc"], 100
    ).select("a", "b").collect()
    assert len(out) == len(want) and {tuple(r) for r in out} == want


def test_locate_keeps_original_offsets(spark):
    text = "One  day\n\n the   key fell. Then THE KEY fell again."
    rows = spark.createDataFrame([(text, "the key  fell", None), (text, "the key fell", 0.99), (text, "absent", None)], "t string, s string, near double")
    got = [r.at for r in G.locate_nearest(rows, "t", "s", "near").collect()]
    assert got == [text.index("the   key"), text.index("THE KEY"), -1]


def test_repair_accepts_punctuation_only(spark):
    text = 'He said, "Leave the garden gate open tonight, please," and left the house quietly.'
    cases = [
        ("garden gate open tonight", "garden gate open tonight", False),
        ("Leave the garden gate -- open tonight; please", "Leave the garden gate open tonight, please", True),
        ("Leave the garden gate ... left the house quietly", 'Leave the garden gate open tonight, please," and left the house quietly', True),
        ("They unlocked the garden door last night", None, False),
        ("He said ...", None, False),
    ]
    rows = spark.createDataFrame([(i, text, e) for i, (e, _, _) in enumerate(cases)], "i int, text string, evidence string")
    got = {r.i: (r.grounded, r.repaired) for r in G.grounded_evidence(rows).collect()}
    assert got == {i: (g, f) for i, (_, g, f) in enumerate(cases)}


def test_relocation_needs_a_unique_line(spark):
    lines = spark.createDataFrame([("d", 0, 0, "alpha one"), ("d", 1, 0, "beta two"), ("d", 2, 0, "beta three"), ("d", 3, 1, "alpha one")], "doc string, seq long, group int, body string")
    quotes = spark.createDataFrame([("d", 1, 0, 0, "alpha"), ("d", 2, 0, 1, "one"), ("d", 3, 0, 0, "beta"), ("d", 4, 0, 9, "three")], "doc string, q int, group int, requested long, needle string")
    got = {r.q: (r.seq, r.relocated) for r in G.relocated(quotes, lines, ["doc"], ["q"]).collect()}
    assert got == {1: (0, False), 2: (0, True), 3: (None, None), 4: (2, True)}


def test_evidence_next_chunk(spark):
    chunks = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 8, 18), (1, 2, 16, 20)], "doc int, chunk_idx int, start int, end int")
    points = spark.createDataFrame([(1, 1, 2, 3), (1, 2, 5, 4), (1, 3, 17, 2)], "doc int, p int, pos int, length int")
    got = {tuple(r) for r in G.evidence_chunks(points, chunks, ["doc"], ["p"]).select("p", "chunk_idx").collect()}
    assert got == {(1, 0), (2, 0), (2, 1), (3, 2)}
    assert points.select(F.count("*")).first()[0] == 3


def test_quotes_located_in_chunks(spark):
    """The occurrence closest to the expected place, over chunk borders, whatever the white space and case."""
    text = "same evidence" + " x" * 900 + " Same \n evidence" + " y" * 700 + " alpha\n\n\n beta\r\n gamma target phrase omega" + " ha ha ha"
    docs = spark.createDataFrame([(1, text), (2, "nothing here"), (3, "")], "doc_id int, text string")
    chunks = S.chunk_fixed(docs)
    quotes = [(1, 0, "same   evidence", 0.95), (1, 1, "SAME evidence", None), (1, 2, "same evidence", 0.0), (1, 3, "target   phrase", 0.1), (1, 4, "absent", 0.5), (1, 5, " ", 0.5), (2, 6, "here", 0.0), (3, 7, "x", 0.0), (1, 8, "beta gamma", None)]
    rows = spark.createDataFrame(quotes, "doc_id int, id int, quote string, near double")
    got = {r.id: (r.pos, r.length) for r in G.locate_quotes(rows, chunks, ["doc_id"], ["id"]).collect()}
    assert got == {0: (text.index("Same"), 15), 1: (0, 13), 2: (0, 13), 3: (text.index("target"), 15), 6: (8, 4), 8: (text.index("beta"), 10)}


def test_passage_blend_over_the_largest_mass(spark):
    lexical = spark.createDataFrame([(1, 0, 0.5), (1, 1, 1.0), (2, 0, 0.4)], "q int, chunk_idx int, score double")
    mass = spark.createDataFrame([(1, 0, 3.0), (1, 2, 6.0), (2, 0, 0.0)], "q int, chunk_idx int, mass double")
    got = {(r.q, r.chunk_idx): round(r.score, 9) for r in R.passage_scores(lexical, mass, ["q"]).collect()}
    assert got == {(1, 0): 0.48 * 0.5 + 0.52 * 0.5, (1, 1): 0.48, (1, 2): 0.52, (2, 0): round(0.48 * 0.4, 9)}


def test_texts_held_by_words_equal_brute_force(spark):
    rng = random.Random(8)
    words = ["a", "ab", "b", "ba", "abc", "", "ring", "ringer"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 5))).strip()
    needles = sorted({(rng.randint(1, 2), t) for _ in range(120) if (t := text())})
    hay = [(rng.randint(1, 2), rng.randint(0, 60), t) for _ in range(150) if (t := text())]
    a, b = spark.createDataFrame(needles, "k int, n string"), spark.createDataFrame(hay, "k int, unit int, body string")
    want = {(k, n, u) for k, n in needles for j, u, body in hay if k == j and n in body}
    assert {tuple(r) for r in G.held_texts(a, b, ["k"], "n", "body").collect()} == want
    few = [tuple(r) for r in G.held_texts(a, b, ["k"], "n", "body", ("unit", 2)).collect()]
    for k, n in needles:
        all_units = sorted(u for i, m, u in want if (i, m) == (k, n))
        assert sorted({u for i, m, u in few if (i, m) == (k, n)}) == all_units[:2]


def test_a_quote_of_several_ids_is_looked_for_once(spark):
    """Ids that share a quote each get the occurrence closest to their own place, and the text meets the quote once."""
    text = "the key" + " x" * 200 + " The  KEY" + " y" * 200 + " the key end"
    chunks = S.chunk_fixed(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    rows = spark.createDataFrame([(1, i, "the  key" if i % 2 else "the key", i / 20) for i in range(21)], "doc_id int, id int, quote string, near double")
    found = G.locate_quotes(rows, chunks, ["doc_id"], ["id"])
    at = [m.start() for m in re.finditer(r"the\s+key", text, re.I)]
    want = {i: (min(at, key=lambda p: (abs(p - max(0, min(len(text) - 1, int(i / 20 * len(text))))), p)), 8 if i % 2 else 7) for i in range(21)}
    assert {r.id: (r.pos, r.length) for r in found.collect()} == want and len(set(want.values())) >= 4
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    above = [x for x, y in zip(lines, lines[1:]) if "Generate explode(" in y and "split(" in y]
    assert above and all("nq#" in x and not re.search(r"\bid#", x) for x in above)
