"""Suffix dedup of rows that share an id, or have none, but not the text."""

import random

from evigraph.llm import suffix_dedup


def removed(text, earlier):
    """Text without the bytes of every 100-byte string that also starts earlier, here or in ``earlier``."""
    seen = {t[p : p + 100] for t in earlier for p in range(len(t) - 99)}
    gone = set()
    for p in range(len(text) - 99):
        if text[p : p + 100] in seen:
            gone.update(range(p, p + 100))
        seen.add(text[p : p + 100])
    return bytes(c for i, c in enumerate(text) if i not in gone)


def test_spans_stay_with_their_text(make_docs):
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    shared = noise(300)
    # The first text repeats itself; others of its id only have the same length, or share a passage with it.
    own = noise(150)
    rows = [(i, t) for i in (None, 7) for t in (own + noise(40) + own, noise(340), noise(500) + shared, shared + noise(90), noise(340), shared[:130])]
    rows += [(7, rows[0][1]), (9, noise(60) + shared)]
    got = suffix_dedup.remove_repeats(make_docs([*rows, *rows[:3]], 4), keep=("n_chars",)).collect()
    hashed = make_docs(rows, 1).selectExpr("doc_id", "text", f"coalesce(doc_id, {suffix_dedup.NO_ID}) AS doc", "xxhash64(text) AS row").distinct().orderBy("doc", "row").collect()
    want, earlier = {}, []
    for r in hashed:
        raw = r["text"].encode()
        want[(r["doc_id"], raw)] = removed(raw, earlier)
        earlier.append(raw)
    expected = sorted(((i is None, i or 0, len(t), want[(i, t.encode())]) for i, t in [*rows, *rows[:3]]), key=repr)
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], bytes(r["kept"])) for r in got), key=repr) == expected
