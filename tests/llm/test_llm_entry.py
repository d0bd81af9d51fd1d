"""The training-data queries against their SQL on the smallest tables, where these are there."""

import pytest

import __spark_entry__ as entry
from latticework.llm import queries
from test_entry import DATA, duck, same  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_like_sql(spark, duck, name):  # noqa: F811
    df = entry.queries()[name](spark, DATA)
    r = duck.execute(queries.SQL[name])
    names = [c[0] for c in r.description]
    want = sorted(tuple(same(x) for _, x in sorted(zip(names, row))) for row in r.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(same(x) for _, x in sorted(row.asDict().items())) for row in df.collect()) == want


def test_every_problem_has_a_query():
    assert {n[:2] for n in queries.QUERIES} == {"p1", "p4", "p6", "p7", "p8", "p9"}
