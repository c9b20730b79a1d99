"""Registered queries: every one is well-formed; a sample runs against its SQL on the smallest tables."""

import re

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from evigraph.common import TABLES
from tools.check_queries import rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "chunk_fixed", "story_order", "entities_validated", "evidence_to_line", "graph_quality", "bm25_top", "retrieve_khop", "diverse_select",
    "vote_majority", "logo_rule", "mcnemar", "report_cube", "src_tree_leaves", "stream_rate_tumbling",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_every_query_has_sql_or_a_fixture_test():
    own = {n for n in queries() if n != "pipeline" and not re.match(r"op\d+_", n)}  # the training-data operators have tests of their own
    assert own - set(oracle_sql()) == {"consolidate_plan", "name_compatible"}
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_sample_matches_sql(spark, con, name):
    df = queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(oracle_sql()[name])
    assert got == rows_of([c[0] for c in cur.description], cur.fetchall()) and got[1]


def test_partitioning_does_not_change_results(spark):
    seen = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append([sorted(map(tuple, queries()[q](spark, SF).collect())) for q in ("story_order", "bm25_top", "cluster_bootstrap")])
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert seen[0] == seen[1]
