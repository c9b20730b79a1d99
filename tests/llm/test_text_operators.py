"""URL rules, token counts, classifiers and mixing against brute force, with awkward rows."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

public_tokenizers = pytest.importorskip("public_tokenizers")

from evigraph.llm import mixing, quality_rules, token_count, toxicity, url_filter

AWKWARD = ["", None, " ", "a", "x" * 5000, "word " * 3000, "Ünïcödé 漢字 👩‍👩‍👧", "tab\tline\nnul\x00end", "<|endoftext|> twice <|endoftext|>"]


def test_url_rules_and_model(spark):
    urls = [
        None, "", "no scheme", "http://", "HTTP://A.COM", "https://Www.Example.COM/en/a?x#y", "https://a.example.com/en/1", "https://example.com/en/", "https://example.com/english",
        "https://com/", "https://xcom/", "https://a.net/es/1", "https://a.net/fr", "https://a.net/fr/#/es/", "ftp://a.b://c.com/x", "https://a.net?q=/es/", "http://a.com/" + "z" * 4000,
    ] + [f"https://h{i % 7}.example.{'com' if i % 2 else 'net'}/{'de' if i % 2 else 'es'}/{i}" for i in range(200)]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, codes string")
    got = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        at = (url or "").find("://")
        rest = url[at + 3 :] if at >= 0 else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        fits = [(v, r) for v, r in url_filter.DEFAULT_RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        verdict, rule = max(fits, key=lambda x: len(x[1]), default=(None, None))
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == verdict if verdict else got[i]["verdict"] in ("allow", "block")
    # Scores against the smoothed model written out in Python.
    def symbols(host, path):
        out = []
        for c in (host + path).lower():
            c = "0" if c in "0123456789" else c
            out.append(url_filter.ALPHABET.index(c) + 1 if c in url_filter.ALPHABET[:-1] else url_filter.ALPHABET.index("?") + 1)
        return [0, 0, *out, url_filter.ALPHABET.index("$") + 1]

    count = {k: defaultdict(int) for k in ("allow", "block")}
    for i, url in enumerate(urls):
        if got[i]["rule"] and zlib.crc32(url.encode()) % url_filter.FOLDS:
            s = symbols(got[i]["host"], got[i]["path"])
            for x in zip(s, s[1:], s[2:]):
                count[got[i]["verdict"]][x] += 1

    def logp(n, a, b, c):
        total = lambda f: sum(v for k, v in n.items() if f(k))
        kinds = lambda f: len({k[2] for k in n if f(k)})
        p = (total(lambda k: k[2] == c) + 1) / (total(lambda k: True) + url_filter.A)
        for f in (lambda k: k[1] == b, lambda k: k[:2] == (a, b)):
            if total(f):
                p = (total(lambda k: f(k) and k[2] == c) + kinds(f) * p) / (total(f) + kinds(f))
        return np.log(p)

    for i in (3, 9, 14, 40, 41):
        s = symbols(got[i]["host"], got[i]["path"])
        want = np.mean([logp(count["allow"], *x) - logp(count["block"], *x) for x in zip(s, s[1:], s[2:])])
        assert got[i]["score"] == pytest.approx(want, abs=1e-9)


def test_url_filter_without_labels(spark):
    pages = spark.createDataFrame([(1, "https://a.org/x"), (None, None)], "page_id long, url string")
    assert {(r["page_id"], r["verdict"], r["score"]) for r in url_filter.judge(pages).collect()} == {(1, "allow", 0.0), (None, "allow", 0.0)}
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_token_counts_match_the_library(spark, make_docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(3)
    alphabet = [chr(c) for c in [*range(0x250), 0x85, 0xA0, 0x2028, 0x3000, 0x4E2D, 0x1F600, 0x200D, 0x300, 0x661, 0xBD, 0x1C, 0xFEFF]]
    texts = AWKWARD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    docs = make_docs([(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (0, "again")])
    got = sorted(map(tuple, token_count.token_counts(docs, path).collect()), key=repr)
    want = []
    for i, t in [*enumerate(texts), (None, "null id"), (0, "again")]:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 1024))
    assert got == sorted(want, key=repr)
    assert token_count.token_counts(docs.limit(0), path).count() == 0


def test_rule_ensemble_separates_and_compiles(spark, make_docs):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    good = [(i, " ".join(rng.choice(words) + str(i % 7) for _ in range(60)) + ".") for i in range(120)]
    bad = [(1000 + i, rng.choice([" ".join(["same"] * 60), " ".join(rng.choice(words).upper() + "!!" for _ in range(60))])) for i in range(60)]
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1), (5, None)], "doc_id long, quality int")
    docs = make_docs(good + bad + [(5000 + i, t) for i, t in enumerate(AWKWARD)])
    model = quality_rules.fit(docs, labels)
    assert model.rules and quality_rules.fit(docs.repartition(7), labels) == model
    rows = {r["doc_id"]: r for r in quality_rules.score(docs, model, ["doc_id"]).collect()}
    assert all(rows[i]["predicted"] == 1 for i, _ in good) and all(rows[i]["predicted"] == 0 for i, _ in bad)
    for i, t in enumerate(AWKWARD):
        stats = dict(zip(quality_rules.STATS, quality_rules.statistics(t or "")))
        z = model.bias + sum(w for w, tests in model.rules if all((stats[s] > at) == above for s, above, at in tests))
        assert rows[5000 + i]["score"] == pytest.approx(1 / (1 + np.exp(-z)))
    none = quality_rules.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality_rules.score(docs, none, ["doc_id"]).collect()} == {0.5}


def test_toxicity_finds_unseen_inflections(spark, make_docs):
    rng = random.Random(6)
    neutral = ["house", "river", "table", "green", "walk", "stone", "cloud", "paper", "light", "winter"]
    stems, ends = ["grumbl", "snarv"], ["ed", "ing", "er", "ous", "ity", "al"]
    text = lambda bad: " ".join([rng.choice(neutral) for _ in range(rng.randint(20, 200))] + bad + [rng.choice(neutral) for _ in range(30)])
    rows = [(i, text([])) for i in range(150)] + [(1000 + i, text([rng.choice(stems) + rng.choice(ends[:4])])) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i >= 1000)) for i, _ in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    unseen = [(2000 + i, text([s + e])) for i, (s, e) in enumerate((s, e) for s in stems for e in ends[4:])]
    docs = make_docs(rows + unseen + [(5000 + i, t) for i, t in enumerate(AWKWARD)])
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i]["predicted"] == (i >= 1000) for i, _ in rows) and all(got[i]["score"] > 0.5 for i, _ in unseen)
    assert got[5000]["score"] == got[5001]["score"] == got[5002]["score"] and all(0 <= r["score"] <= 1 for r in got.values())
    again = toxicity.fit(docs.repartition(5), labels)
    assert np.array_equal(again.weights, model.weights)
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0.5}


def test_budget_table_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(150):
        lengths = rng.choice(np.arange(0, 40), rng.integers(1, 7), replace=False)
        counts = rng.integers(1, 4, len(lengths))
        sums = {0}
        for n, c in zip(lengths.tolist(), counts.tolist()):
            sums = {s + n * j for s in sums for j in range(c + 1)}
        budget = int(rng.integers(0, (lengths * counts).sum() + 3))
        took = mixing.fit_budget(lengths, counts, budget)
        assert (took <= counts).all() and (took >= 0).all()
        assert abs(int((took * lengths).sum()) - budget) <= budget - max(s for s in sums if s <= budget)
    assert mixing.fit_budget(np.array([3, 5]), np.array([10, 10]), 71) @ np.array([3, 5]) == 71


def test_mix_meets_targets(spark, make_docs):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randint(0, 90)), rng.choice(["a", "a", "a", "b", "c", None, "é"])) for i in range(600)] + [(9000, None, "b"), (9001, "", "only"), (None, "null id", "a")]
    docs = make_docs(rows)
    plan = mixing.mix_plan(docs).collect()
    sizes, source = defaultdict(int), {}
    for i, t, s in rows:
        sizes[s] += len((t or "").split())
        source[i] = s
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = dict(zip(names, [5, 2, 1] * 3))
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] >= 2 * sizes[s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.discard(s)
    taken = defaultdict(int)
    assert len(plan) == len(rows)
    for r in plan:
        s = source[r["doc_id"]]
        assert r["target"] == pytest.approx(target[s]) and r["source_size"] == sizes[s] and r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 2 for s in names)
    assert sorted(map(tuple, mixing.mix_plan(docs.repartition(7)).collect()), key=repr) == sorted(map(tuple, plan), key=repr)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and sum(len((r["text"] or "").split()) for r in out.collect()) == sum(taken.values())
    assert mixing.mix_plan(docs.limit(0)).count() == 0
