import random
from collections import Counter

import pytest

from latticework.llm.iceberg import frequent_values


def data(seed, n=4000):
    rng = random.Random(seed)
    return [(None if (r := rng.random()) < 0.1 else 1 if r < 0.3 else 2 if r < 0.35 else rng.randrange(1000), 1) for _ in range(n)]


@pytest.mark.parametrize("share,buckets", [(0.01, 0), (0.05, 8), (0.001, 0), (1.0, 0), (1e-7, 0), (0.0005, 64), (0.3, 1)])
def test_like_counting(spark, share, buckets):
    rows = data(int(share * 100))
    df = spark.createDataFrame(rows, "value long, n int")
    c = Counter(v for v, _ in rows if v is not None)
    got = frequent_values(df, "value", share, buckets=buckets).collect()
    assert {r.value: r.n for r in got} == {v: n for v, n in c.items() if n >= share * sum(c.values())}
    assert all(r.at_most >= r.n for r in got)


def test_exact_share_text_and_empty(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 4 + [("c",)] + [(None,)] * 9, "cell string")
    assert {r.value: r.n for r in frequent_values(df, "cell", 0.4).collect()} == {"a": 5, "b": 4}
    assert frequent_values(df.limit(0), "cell", 0.4).count() == 0
    assert frequent_values(df.where("cell is null"), "cell", 0.4).count() == 0


def test_bounds(spark):
    df = spark.range(3)
    for bad in ({"share": 0.0}, {"share": 1.5}, {"share": 0.5, "buckets": 1000}):
        with pytest.raises(ValueError):
            frequent_values(df, "id", **bad)
