"""Derived inputs grow with the tables they come from."""

from evigraph.plans.inputs import relation
from tests.test_queries import SF


def test_every_part_asks(spark):
    parts = {r["p_partkey"] for r in spark.read.parquet(f"{SF}/part.parquet").select("p_partkey").collect()}
    rows = relation(spark, SF, "graph_questions").collect()
    assert {r["qid"] // 25 for r in rows} == parts and len(rows) == len(parts) == len({r["qid"] for r in rows})
    assert {r["graph_id"] for r in rows} == {p % 25 for p in parts}
    assert all(r["question"] and r["choice_a"] and r["choice_b"] for r in rows)


def test_scratch_folder_without_a_setting(monkeypatch):
    """Local mode without spark.checkpoint.dir: one folder of its own; a cluster must name one."""
    from types import SimpleNamespace

    import pytest

    from evigraph import common

    monkeypatch.setattr(common, "_own_dirs", [])
    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master=master))
    first = common.shared_dir(session("local[4]"))
    assert first and common.shared_dir(session("local")) == first
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(session("spark://host:7077"))


def test_relations_and_tables_between_steps_stay_narrow(spark, tmp_path):
    """A count of relations keeps no ids and names of theirs, and tables between steps are written small."""
    from evigraph.common import cut_lineage
    from evigraph.plans import graph_queries

    seen = []
    keep = graph_queries.cut_lineage
    try:
        graph_queries.cut_lineage = lambda df: seen.append(df.columns) or keep(df)
        graph_queries.totals_of(spark, "/root/testdata/sf0.001")
    finally:
        graph_queries.cut_lineage = keep
    assert seen == [["graph_id", "type", "evidence", "src", "dst"]]
    ids = spark.range(20000).selectExpr("substr(md5(cast(id as string)), 1, 16) AS edge_id")
    table = cut_lineage(ids.coalesce(1))
    from pathlib import Path
    size = sum(p.stat().st_size for p in Path(table._scratch).rglob("*.parquet"))
    assert size < 20000 * 13 and table.count() == 20000


def test_edges_move_few_rows(spark, tmp_path):
    """Lines are shuffled twice and parted into edges after that; equal rows are still one edge, missing ends none."""
    import duckdb

    from evigraph.plans import inputs

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("customer", "part", "orders", "lineitem"):
        con.execute(f"create table {t} as select * from '{SF}/{t}.parquet'")
    con.execute("insert into lineitem select * from lineitem where l_orderkey % 7 = 0")
    con.execute("insert into lineitem select * replace (99999999 as l_partkey) from lineitem limit 5")
    con.execute("insert into part select * from part where p_partkey % 50 = 0")
    for t in ("customer", "part", "orders", "lineitem"):
        con.execute(f"copy {t} to '{tmp_path}/{t}.parquet' (format parquet)")
    want = con.execute(f"select graph_id, src, dst, type, evidence, confidence, decoy, importance, edge_id from ({inputs.CHECK_SQL['edges']})").fetchall()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        df = inputs._derive(spark, str(tmp_path), "edges").select("graph_id", "src", "dst", "type", "evidence", "confidence", "decoy", "importance", "edge_id")
        moves = df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        got = df.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert moves == 6  # three joins of two sides, and none to drop equal rows
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 10_000
