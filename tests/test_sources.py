"""Readers on awkward files, neighbour expansion at text ends, and loops of many rounds."""

import json

import pyarrow as pa
from pyspark.sql import functions as F

from evigraph.operators import graph as G, iterate as I, select as C
from evigraph.sources import readers as R
from evigraph.streaming import jobs as J


def test_concatenated_json(spark, tmp_path):
    objects = [{"id": 1, "t": "a"}, {"id": 2, "t": "braces } { inside"}, {"id": 3, "t": 'quote \\" } {"id": 9}'}, {"id": 4, "t": "x\ny"}]
    (tmp_path / "a.json").write_text("﻿" + json.dumps(objects[0]) + json.dumps(objects[1], indent=1) + " \t\n" + json.dumps(objects[2]) + "\n\n" + json.dumps(objects[3]))
    (tmp_path / "b.json").write_text('{"id": 5, "t": "ok"} {"id": 6, "t": broken')
    (tmp_path / "c.json").write_text("")
    rows = R.read_concatenated_json(spark, str(tmp_path), "id long, t string", "bad").collect()
    assert {(r.id, r.t) for r in rows if r.bad is None} == {(o["id"], o["t"]) for o in objects} | {(5, "ok")}
    assert [r.bad for r in rows if r.bad is not None] == ['{"id": 6, "t": broken']
    assert R.read_concatenated_json(spark, str(tmp_path), "id long, t string").count() == 5


def test_answer_tree(spark, tmp_path):
    for name, text in {
        "1/a.json": json.dumps({"qid": 1, "selected": "A"}, indent=1), "1/b.json": json.dumps([{"qid": 2, "selected": "B"}, {"qid": 3, "selected": "C"}], indent=1),
        "2/a.json": '{"qid": 3, "selected": "D"}\n{"qid": 4, "selected": "E"}\n', "2/c.json": "not json", "2/d.txt": '{"qid": 9}',
    }.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = R.read_answer_tree(spark, str(tmp_path), "qid long, selected string")
    assert {(r.qid, r.selected) for r in got.collect()} == {(1, "A"), (2, "B"), (3, "D"), (4, "E")}
    with_bad = R.read_answer_tree(spark, str(tmp_path), "qid long, selected string", corrupt="bad").collect()
    assert len(with_bad) == 5 and [r.bad for r in with_bad if r.qid is None] == ["not json"]


def test_quoted_items(spark):
    values = ["Bob's flat", "the mill", 'it\'s "here"', "back\\slash", "two\nlines", ""]
    row = spark.createDataFrame([(repr(values),)], "choices string").select(R.quoted_items("choices")).first()
    assert row[0] == values


def test_tree_leaves_of_any_depth(spark):
    tree = {"value": "leaf", "fact_type": "fact", "prunable": True}
    for i in range(66):
        tree = {"value": str(i), "operator": "and", "children": [tree]}
    rows = R.tree_leaves(spark.createDataFrame([(1, json.dumps(tree))], "k int, tree string"), ["k"]).collect()
    assert [(r.value, r.fact_type, r.prunable, r.path) for r in rows] == [("leaf", "fact", True, ".".join(["0"] * 66))]


def test_neighbours_stay_inside_the_text(spark):
    unit = 1 << 31
    units = spark.createDataFrame([(t * unit + i,) for t in (1, 2) for i in range(4)], "unit long")
    picked = spark.createDataFrame([(1, [2 * unit, unit + 3, unit + 1])], "qid int, top array<long>")
    got = C.expand_neighbors(picked, units, ["qid"], "top", 1, 9).orderBy("pos").collect()
    assert [r.unit for r in got] == [2 * unit, unit + 3, unit + 1, 2 * unit + 1, unit + 2, unit]


def test_core_of_a_chain_is_empty(spark):
    pairs = spark.createDataFrame([(1, f"n{i:03}", f"n{i + 1:03}") for i in range(24)] + [(1, "a", "b"), (1, "b", "c"), (1, "a", "c")], "graph_id int, a string, b string")
    assert {(r.a, r.b) for r in I.k_core(pairs, ["graph_id"]).collect()} == {("a", "b"), ("b", "c"), ("a", "c")}


def test_alias_arrays_and_victims(spark):
    nodes = spark.createDataFrame([(1, "n1", "Alice", ["The Countess", None], "person"), (1, "n2", "Bob", None, "person"), (1, "n3", "Knife", [], "clue_object")], "graph_id int, node_id string, name string, aliases array<string>, type string")
    rel = spark.createDataFrame([(1, "countess", "knife")], "graph_id int, source string, target string")
    assert [(r.src, r.dst) for r in G.resolved_endpoints(rel, nodes).collect()] == [("n1", "n3")]
    assert {r.node_id for r in G.referenced_nodes(nodes, rel).collect()} == {"n1", "n3"}
    said = spark.createDataFrame([(1, 7, "Who saw the countess with Bob?")], "graph_id int, qid int, text string")
    assert {r.node_id for r in G.name_mentions(nodes, said).collect()} == {"n1", "n2"}
    edges = spark.createDataFrame([(1, "e1", "n1", "n3", "motive", 0.9, False, 3), (1, "e2", "n2", "n3", "motive", 0.8, False, 3)], "graph_id int, edge_id string, src string, dst string, type string, confidence double, decoy boolean, importance int")
    best, _ = G.suspect_chain(nodes, edges, victims=spark.createDataFrame([(1, "ALICE")], "graph_id int, victim string"))
    assert [r.src for r in best.collect()] == ["n2"]
    tier = G.victim_neighbours(nodes, edges, spark.createDataFrame([(1, "n3")], "graph_id int, node_id string"))
    assert {r.name for r in tier.collect()} == {"Alice", "Bob"} and tier.select(F.max("tier")).first()[0] == 0


def test_votes_close_when_idle(spark, tmp_path):
    feed, schema = tmp_path / "in", "qid long, morder long, selected string, ts timestamp"
    at = lambda minute: f"2024-01-01T00:{minute:02}:00.000Z"
    batches = [
        [(1, 1, "A", 0), (1, 2, "B", 1), (2, 1, "C", 1), (4, 1, None, 1), (3, 1, "A", 30)],  # watermark then 00:28
        [(1, 3, "A", 2), (3, 2, "A", 29), (3, 2, "D", 31), (5, 1, "B", 50)],  # question 1 comes too late
        [(2, 2, "D", 49), (2, 3, "D", 49), (5, 2, "B", 59)],  # question 2 anew, watermark then 00:57
        [(6, 1, "A", 59)],
    ]
    for n, rows in enumerate(batches):
        feed.mkdir(exist_ok=True)
        lines = [json.dumps({"qid": q, "morder": m, "selected": x, "ts": at(t)}) for q, m, x, t in rows]
        (feed / f"{n}.json").write_text("\n".join(lines))
        df = J.closing_votes(J.json_feed(spark, str(feed), schema), "2 minutes", 5 * 60_000)
        out = J.run_to_files(df, str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted(((r.qid, r.winner, r.cast) for r in out.collect()), key=lambda r: (r[0], r[2]))
    # 5 and 6 are still open; the second sitting of 2 has closed (00:49 + 5 before 00:57)
    assert got == [(1, "B", 2), (2, None, 1), (2, "D", 2), (3, "A", 2), (4, None, 0)]


def test_json_values_are_cut_in_bounded_pieces(monkeypatch):
    """However few bytes are text at a time, the values, their places and what is broken stay the same."""
    files = [
        "", "﻿ ﻿", '﻿{"a": "é漢😀}{"} [1, {"b": "\\"]"}] 12 -3.5e+10 7e2 true "x y"  null', '{"a": 1}{"b": [1, 2]}\n\t{"c"', "1.5 2", '{"long": "' + "漢字" * 60 + '"}3', "x", None,
    ]
    batch = pa.record_batch([pa.array([f"f{i}" for i in range(len(files))]), pa.array(files)], ["path", "value"])
    cut = lambda: [tuple(r.values()) for b in R._cut_objects(iter([batch])) for r in b.to_pylist()]
    whole = cut()
    assert [r[2] for r in whole if r[0] == "f2"] == ['{"a": "é漢😀}{"}', "1", '{"b": "\\"]"}', "12", "-3.5e+10", "7e2", "true", '"x y"', "null"]
    assert [r[1:] for r in whole if r[0] in ("f3", "f6")] == [(0, '{"a": 1}', False), (1, '{"b": [1, 2]}', False), (2, '{"c"', True), (0, "x", True)]
    for width in (4, 5, 7, 16, 50):
        monkeypatch.setattr(R, "WINDOW", width)
        assert cut() == whole
        assert max(b.num_rows for b in R._cut_objects(iter([batch]))) <= width + 1


def test_whole_texts_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    from evigraph.plans import source_queries

    monkeypatch.setattr(source_queries, "scratch_path", lambda spark, name: str(tmp_path / name))
    source_queries.src_wholetext(spark, "/root/testdata/sf0.001")
    tasks = {p.name.split("-")[1] for p in (tmp_path / "texts").rglob("part-*.txt")}
    assert len(tasks) == spark.sparkContext.defaultParallelism
