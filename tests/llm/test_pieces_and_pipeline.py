"""Sampled segmentations, the registered queries and the pipeline."""

import itertools
import math
import re
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from evigraph.llm import piece_sampler
from evigraph.llm.common import read

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return piece_sampler.PieceModel(PATH, 0.3)


def segmentations(model, text):
    """All segmentations of a normalised text with their probabilities."""
    lattices = piece_sampler.Lattices(model)
    found = []
    for unit in lattices.split("▁" + text.replace(" ", "▁")):
        ways = [((), 0.0, 0)]
        done = []
        while ways:
            ids, w, at = ways.pop()
            if at == len(unit):
                done.append((ids, w))
            for end in range(at + 1, len(unit) + 1):
                if (p := unit[at:end]) in model.ids:
                    ways.append(((*ids, model.ids[p]), w + model.weights[p], end))
        found.append(done)
    joint = Counter()
    for parts in itertools.product(*found):
        joint[tuple(x for ids, _ in parts for x in ids)] = math.exp(sum(w for _, w in parts))
    total = sum(joint.values())
    return {k: v / total for k, v in joint.items()}


def test_sampling_law_without_replacement(model):
    """Frequencies of the ordered pair (first, second) over many row keys follow sampling without replacement."""
    want = segmentations(model, "ab on")
    sampler = piece_sampler.Sampler(model, 2, 1)
    n = 6000
    pairs = Counter()
    for found in sampler(list(range(n)), ["ab on"] * n):
        a, b = (tuple(ids.tolist()) for ids, _, _ in found)
        assert a != b
        for ids, lp, q in found:
            assert lp == pytest.approx(math.log(want[tuple(ids.tolist())]), abs=1e-9) and 0 < q <= 1
        pairs[a, b] += 1
    worst = 0.0
    for a, b in itertools.permutations(want, 2):
        p = want[a] * want[b] / (1 - want[a])
        worst = max(worst, abs(pairs[a, b] - n * p) / math.sqrt(n * p * (1 - p) + 1))
    assert worst < 5


def test_all_segmentations_come_out_once(model):
    want = segmentations(model, "the")
    found = piece_sampler.Sampler(model, len(want) + 5, 3)(["k"], ["the"])[0]
    assert sorted(tuple(ids.tolist()) for ids, _, _ in found) == sorted(want) and all(q == 1.0 for _, _, q in found)


def test_inclusion_scores_are_unbiased(model):
    """Sums weighted by probability over inclusion estimate the whole (Horvitz-Thompson)."""
    want = segmentations(model, "and the")
    totals = [sum(math.exp(lp) / q for _, lp, q in found) for found in piece_sampler.Sampler(model, 3, 9)(list(range(4000)), ["and the"] * 4000)]
    assert np.mean(totals) == pytest.approx(1.0, abs=0.03) and len(want) > 5


def test_round_trip_and_awkward_rows(spark, make_docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [None, "", " ", "  a  b ", "漢字 \x00 👩‍👧 é", "tab\tline\n", "x" * 3000, "word " * 2000, "same", "same"]
    docs = make_docs([(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (8, "same")])
    got = piece_sampler.sample_encodings(docs, PATH, k=3)
    rows = got.collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        text = "no id" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        assert sp.decode(r["ids"]) == text
    assert len(by[0]) == len(by[1]) == 1 and by[0][0]["ids"] == [] and by[0][0]["inclusion"] == 1.0
    assert len(by[8]) == 6 and len({tuple(r["ids"]) for r in by[8]}) == 3
    again = piece_sampler.sample_encodings(docs.repartition(1), PATH, k=3).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))
    texts_again = {(r["doc_id"], r["rank"]): r["text"] for r in piece_sampler.decode(got, PATH, ["doc_id", "rank"]).collect()}
    assert all(t == ("no id" if i is None else texts[i] or "") for (i, _), t in texts_again.items())
    assert piece_sampler.sample_encodings(docs.limit(0), PATH).count() == 0


def test_every_operator_is_registered():
    names = queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert set(oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", [n for n in queries() if re.match(r"op\d+_", n)])
def test_query_gives_one_row_per_input(spark, name):
    df = queries()[name](spark, SF)
    key = df.columns[0]
    table = {"page_id": "pages", "vec_id": "embeddings", "query_id": "embeddings"}.get(key, "documents")
    ids = {r[0] for r in read(spark, SF, table).select("vec_id" if key == "query_id" else key).collect()}
    assert {r[0] for r in df.select(key).collect()} == ({i for i in ids if i % 20 == 0} if key == "query_id" else ids)


def test_pipeline_stages(spark):
    """Each stage against what its operator says of its own input; the near-duplicate and repeat stages against brute force."""
    docs = read(spark, SF, "documents")
    seen = {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, SF))
        seen[name] = docs.collect()
        if name != "pieces":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and seen[name]
    labels = {r["doc_id"]: r["quality"] for r in read(spark, SF, "labels").collect()}
    kept = {r["doc_id"] for r in seen["quality"]}
    assert all((i in kept) == bool(q) for i, q in labels.items())

    sets = {}
    for r in seen["quality"]:
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = {tuple(w[j : j + min(5, len(w))]) for j in range(max(1, len(w) - 4))} if w else set()
    left = {r["doc_id"] for r in seen["near_duplicates"]}
    for a, b in itertools.combinations(sorted(left), 2):
        assert not (sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    for gone in set(sets) - left:
        assert any(100 * len(sets[gone] & s) >= 80 * len(sets[gone] | s) for i, s in sets.items() if i != gone)

    windows, n_bytes = set(), 0
    for r in sorted(seen["near_duplicates"], key=lambda r: r["doc_id"]):
        raw, covered = (r["text"] or "").encode(), 0
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in windows:
                n_bytes += 100 - max(0, covered - p)
                covered = p + 100
            windows.add(raw[p : p + 100])
    before, after = (sum(len((r["text"] or "").encode()) for r in seen[s]) for s in ("near_duplicates", "repeats"))
    assert n_bytes <= before - after <= n_bytes * 1.1 + 200 and {r["doc_id"] for r in seen["repeats"]} == left

    sizes = lambda s: sum(len((r["text"] or "").split()) for r in seen[s])
    assert abs(sizes("mixture") - 1.5 * sizes("repeats")) <= 0.03 * sizes("repeats")  # sources of ten texts
    assert max(Counter(r["doc_id"] for r in seen["mixture"]).values()) <= 2
    texts = {r["doc_id"]: r["text"] for r in seen["mixture"]}
    decoder = piece_sampler.PieceModel(PATH)
    assert {r["doc_id"] for r in seen["pieces"]} == set(texts) and all(decoder.decode(r["ids"]) == texts[r["doc_id"]] for r in seen["pieces"])


def test_pipeline_of_awkward_rows(spark, make_docs):
    text = "one two three four five six seven eight nine ten"
    docs = make_docs([(None, text), (None, None), (1, text), (1, text + " x"), (2, ""), (3, None), (4, text), (5, "long " * 4000)])
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, SF))
    assert docs.count() >= 0
    empty = make_docs([(1, text)]).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = corpus_pipeline.cut_lineage(stage(spark, empty, SF))
    assert empty.count() == 0


def test_a_lot_of_texts_of_new_words_needs_little_memory():
    """Several workers share an executor, so what one of them holds for a lot and its lattices is bounded."""
    import tracemalloc

    sampler = piece_sampler.Sampler(piece_sampler.piece_model(public_tokenizers.path("piece_bpe_32k.model")), 2, 5)
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    texts = ["".join(letters[rng.integers(0, 26, 8)]) for _ in range(1 << 17)]
    per = piece_sampler.LOT // 9
    tracemalloc.start()
    for at in range(0, len(texts), per):
        lot = texts[at : at + per]
        sampler([at], [" ".join(lot)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
