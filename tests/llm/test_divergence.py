"""Source divergence against plain counting."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from evigraph.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, least, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, count = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(lower))
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        group = {s: {t: c[t] for t in kept} for (x, s), c in count.items() if x == lang}

        def shares(c):
            total = sum(c.values()) + 5 * len(kept)
            return {t: 1 + 1000000000 * (n + 5) // total for t, n in c.items()}

        p = {s: shares(c) for s, c in group.items()}
        q = shares({t: sum(c[t] for c in group.values()) for t in kept})
        for s in group:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in group if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if group[s][t] and p[s][t] > q[t]]
            for part, found, cap in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(found[:cap], 1)]
    return sorted(out)


def frame(spark, rows, parts=4):
    full = [(*r, 7, "t", 1, "x") for r in rows]
    return spark.createDataFrame(full, "text string, lang string, source string, n long, term string, row int, `a.b` string").repartition(parts)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocab = ["Dog", "dog,", "(DOG)", "dog's", "cat-cat", "Éa", "éa", "漢字", "x1y2", "99", "a b", "c　d", "İ", "K", "--", "[z]", "don't"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(None, "en", "s0"), ("", "en", "s9"), ("1 2 3", "xx", "only"), ("dog", None, None), ("Dog dog", "", ""), (None, None, "s1"), ("dog " * 3000 + "Dog\x0bCAT\x0c", "en", "s0")]
    for i in range(300):
        words = [rng.choice(vocab[: rng.randint(4, len(vocab))]) for _ in range(rng.randint(0, 14))]
        rows.append((rng.choice([" ", "\n", "\t \r"]).join(words), rng.choice(["en", "en", "de"]), "s0" if i % 3 == 0 else f"s{i % 7}"))
    return rows + rows[20:30] * 2


@pytest.mark.parametrize("least,top", [(1, 50), (2, 3), (12, 50), (30, 2), (10_000, 5)])
def test_matches_plain_counts(spark, rows, least, top):
    assert got(divergence.audit(frame(spark, rows), least, top)) == brute(rows, least, top)


def test_small_lots_tiles_and_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(divergence, "ENTRIES", 20)
    monkeypatch.setattr(divergence, "SOURCES", 2)
    monkeypatch.setattr(divergence, "TERMS", 3)
    assert got(divergence.audit(frame(spark, rows, 2), 12, 50)) == brute(rows, 12, 50)


def test_terms_over_many_forms_count_each_document_once(spark):
    """Three forms of one word in overlapping documents: neither bound decides."""
    rows = [("Word word, WORD.", "en", "a")] * 4 + [("word, x", "en", "b")] * 3 + [("Word", "en", "c")] * 2
    for least in (4, 7, 8, 9, 10):
        assert got(divergence.audit(frame(spark, rows), least)) == brute(rows, least, 50)


def test_empty_table(spark):
    assert divergence.audit(frame(spark, [("a", "b", "c")]).limit(0)).count() == 0


def test_large_counts_stay_exact(spark):
    df = spark.createDataFrame([(10**17, 3 * 10**17 + 1), (0, 5), (7, 12)], "n long, t long")
    for r in df.select("n", "t", divergence.share(df["n"], df["t"]).alias("p")).collect():
        assert int(r["p"]) == 1 + 10**9 * (r["n"] + 5) // r["t"]


def test_chunks_are_cut_as_python_cuts_bytes():
    """Texts of one task are cut at once, with the same chunks, counts and documents as one by one."""
    texts = [b"", b"  ", b"\x0b a\x0cb\x1ca \t\n\r", "x y z\u0085 é".encode(), b"dog dog Dog", b"a" * 40 + b" a"]
    owner, code, chunks = divergence._chunks(pa.array(texts, pa.binary()))
    assert [[chunks[c].as_py() for c in code[owner == i]] for i in range(len(texts))] == [t.split() for t in texts]
    held = divergence._Held()
    groups = [("en", "a"), ("en", "b"), ("en", "a"), ("de", "a"), ("en", "b"), ("en", "a")]
    for lo in (0, 3):
        held.add(pa.record_batch([pa.array([g[i] for g in groups[lo : lo + 3]]) for i in (0, 1)] + [pa.array(texts[lo : lo + 3], pa.binary())], ["lang", "source", "text"]))
    held.fold()
    names = list(held.names)
    got = {(names[g], c): (n, d) for c, g, n, d in zip(held.parts[0][0].to_pylist(), *(x.tolist() for x in held.parts[0][1:]))}
    want = {}
    for g, t in zip(groups, texts):
        for c, n in [*Counter(t.split()).items(), (b"", 1)]:
            old = want.get((g, c), (0, 0))
            want[g, c] = (old[0] + n, old[1] + 1)
    assert got == want
