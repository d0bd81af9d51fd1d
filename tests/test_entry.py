"""Queries against their SQL on the smallest tables, where these are there."""

import glob
import os

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = [
    "p2_found", "p2_report", "p3_found", "p3_totals", "p5_found", "p5_mends", "p5_edges", "p5_labels", "edges_simple", "degree_in_out", "nlf",
    "edge_owner", "lcc_bits", "lcc_directed", "nlcc_path", "match_path3", "match_induced_path3", "match_domain_star", "match_given", "label_tail_prob",
    "triangle_per_edge", "bfs_levels", "pagerank_1", "kronecker_small", "upper_triangle", "text_edges", "text_labels", "text_patterns", "pattern_cycles",
    "store_round_trip", "ego_network", "ranking",
]


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 100
    assert set(entry.queries()) - set(entry.oracle_sql()) <= {"p5_repairs", "p7_containers", "p7_fill", "p7_contents", "p8_mix", "p8_shares", "p9_forms"}


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def same(x):
    return f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", NAMES)
def test_like_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    r = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in r.description]
    want = sorted(tuple(same(x) for _, x in sorted(zip(names, row))) for row in r.fetchall())
    got = sorted(tuple(same(x) for _, x in sorted(row.asDict().items())) for row in df.collect())
    assert sorted(df.columns) == sorted(names) and got == want
