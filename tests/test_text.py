"""Scalar functions and segmentation on hand-made rows, including the edge rows."""

import random

import pytest
from pyspark.sql import functions as F

from evigraph.functions import answers as A, text as T
from evigraph.operators import payload as P, segment as S


def one(spark, value, *cols):
    return spark.createDataFrame([(value,)], "x string").select(*cols).first()


def test_time_labels(spark):
    rows = spark.createDataFrame([("Day 2, morning",), ("D3 night",), ("unknown",), ("second 2",)], "x string")
    got = [tuple(r) for r in rows.select(T.time_day("x"), T.time_period("x"), T.time_day("x", strict=True)).collect()]
    assert got == [(2, "morning", 2), (3, "night", 3), (None, "unknown", None), (2, "unknown", None)]


def test_names_and_tokens(spark):
    r = one(spark, "  The  Dobré　 Castle ", T.norm_text("x"), T.canonical_name("x"), T.tokenize("x"))
    assert r[0] == "the dobré castle" and r[1] == "dobr castle" and r[2] == ["the", "dobr", "castle"]
    assert one(spark, "谋杀案 in 1920", T.tokenize("x"))[0] == ["谋杀案", "in", "1920"]


def test_letters(spark):
    texts = ["B", "Answer: C. clue", "The correct option is D", "no selection", "answer A ... final answer: (B)"]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select(A.answer_letter("x")).collect()
    assert [r[0] for r in rows] == ["B", "C", "D", None, "B"]


def test_question_types(spark):
    texts = ["Which is not true?", "Who was the guest, his real identity?", "How many keys?", "Who killed him?", "Who was not killed?"]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select(A.question_type("x")).collect()
    assert [r[0] for r in rows] == ["negative_check", "identity", "quantity_symbol", "killer", "negative_check"]


def test_roles(spark):
    texts = ["Who killed the duke?", "Who was the Accomplice?", "What?"]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select(A.question_role("x")).collect()
    assert [r[0] for r in rows] == ["the killer of the duke", "the accomplice of the killer", "the correct answer"]


def shuffled(digest_hex):
    order = [0, 1, 2, 3]
    raw = bytes.fromhex(digest_hex)
    for i in (3, 2, 1):
        j = raw[i] % (i + 1)
        order[i], order[j] = order[j], order[i]
    return order


def test_permutations_match_byte_shuffle(spark):
    import hashlib

    keys = [f"q{i}" for i in range(60)]
    rows = spark.createDataFrame([(k,) for k in keys], "k string")
    got = rows.select("k", A.permutation4(F.sha2("k", 256)).alias("o"), A.permutation4(F.sha1("k"), True).alias("m")).collect()
    for r in got:
        assert r.o == shuffled(hashlib.sha256(r.k.encode()).hexdigest())
        assert sorted(r.m) == [0, 1, 2, 3] and r.m != [0, 1, 2, 3]


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 18, 19, 25, 37])
def test_chunks_of_every_length(spark, n):
    text = ("ab\U0001f600écdefghij" * 5)[:n]
    rows = S.chunk_fixed(spark.createDataFrame([(1, text)], "doc_id long, text string"), 10, 2).orderBy("chunk_idx").collect()
    want, pos = [], 0
    while pos < n:
        end = min(pos + 10, n)
        want.append((pos, end, text[pos:end]))
        if end == n:
            break
        pos += 8
    assert [(r.start, r.end, r.text) for r in rows] == want


def test_line_packing_never_cuts_lines(spark):
    rng = random.Random(5)
    text = "\n".join("x" * rng.randint(0, 30) for _ in range(80))
    rows = S.chunk_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"), 50).orderBy("chunk_idx").collect()
    assert "\n".join(r.text for r in rows) == text
    assert all(text[r.start : r.end] == r.text for r in rows)
    assert all(len(r.text) + 1 <= 50 or r.first_line == r.last_line for r in rows)


def test_sentence_offsets(spark):
    text = "...Hi there! 你好。 Two?? End"
    rows = S.sentence_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("idx").collect()
    assert [text[r.start : r.end].strip() for r in rows] == [r.text for r in rows] == ["Hi there!", "你好。", "Two??", "End"]


def test_day_fill_across_blocks(spark, monkeypatch):
    days = [None, None, 3, None, 5, None, None, 1, None]
    rows = [(1, i, 0, d) for i, d in enumerate(days)]
    want = [3, 3, 3, 3, 5, 5, 5, 1, 1]
    for size in (1, 2, 4, 4096):
        monkeypatch.setattr(S, "BLOCK", size)
        out = S.day_fill(spark.createDataFrame(rows, "doc_id long, chunk_idx int, span_idx int, day int"), ["doc_id"])
        assert [int(r.day_filled) for r in out.orderBy("chunk_idx").collect()] == want


def test_attribute_shapes(spark):
    texts = ['{"a": 1}', '[{"a": 1}, {"a": 2, "b": 3}]', '[["k", "v"], ["k", "w"]]', '["x: y:z", "none"]', "broken", None]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select(P.attribute_map("x")).collect()
    assert [r[0] for r in rows] == [{"a": "1"}, {"a": "2", "b": "3"}, {"k": "w"}, {"x": "y:z"}, {}, {}]


def test_hallucinated_evidence_is_dropped(spark):
    body = '{"selected_letter":"A","confidence":"HIGH","evidence":{"A":{"support":["c_1","c_77"]}}}'
    row = P.normalized_option_payloads(spark.createDataFrame([(body, ["c_1"])], "payload string, valid_ids array<string>")).first()
    assert row.evidence_ids == ["c_1"] and row.decisive and row.confidence == "high" and not row.needs_more
