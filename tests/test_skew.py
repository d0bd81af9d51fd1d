import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from latticework.operators.heavy import heavy_keys
from latticework.operators import skew
from latticework.operators.skew import keyed_totals, totals

SCHEMA = "id long, k long, n long, w double, n_rows string"


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        if r[1] is not None:
            by[r[1]].append(r)
    out = {}
    for k, some in by.items():
        w = [r[3] for r in some if r[3] is not None]
        out[k] = (len(some), len({r[2] for r in some if r[2] is not None}), round(sum(w), 6) if w else None)
    return out


def rows(seed, n=3000):
    rng = random.Random(seed)
    pick = lambda p, f: None if rng.random() < p else f()
    return [
        (i, pick(0.03, lambda: 7 if rng.random() < 0.5 else rng.randrange(60)), pick(0.1, lambda: 3 if rng.random() < 0.4 else rng.randrange(30)), pick(0.2, lambda: rng.randrange(100) / 4), "x")
        for i in range(n)
    ]


def found_of(some, side):
    return {r.k: (r.n_rows, r.n_neighbours, None if r.sum_weight is None else round(r.sum_weight, 6)) for r in some if r.side == side}


def found(df):
    return {r.k: (r.n_rows, r.n_neighbours, None if r.sum_weight is None else round(r.sum_weight, 6)) for r in df.collect()}


@pytest.fixture
def many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several partitions even for few rows
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("seed,batch", [(1, 10_000), (2, 7), (3, 1)])
def test_like_brute_force(spark, many_partitions, seed, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)  # states go on in the next batch
    try:
        data = rows(seed, 3000 if batch > 10 else 400)
        df = spark.createDataFrame(data, SCHEMA).repartition(5)
        assert found(keyed_totals(df, "k", "n", "w", "id")) == brute(data)
        both = totals(df, [("k", "n"), ("n", "k")], "w", "id").collect()
        assert {r.k: r.n_rows for r in both if r.side == "n"} == {k: v[0] for k, v in brute([(a, c, b, w) for a, b, c, w, _ in data]).items()}
        assert found_of(both, "k") == brute(data) and found_of(both, "n") == brute([(a, c, b, w) for a, b, c, w, _ in data])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_states_of_one_pair_are_stitched(spark, many_partitions):
    data = [(i, 1, 5 if i % 3 else None, 1.0, "x") for i in range(2000)] + [(i, 2, i % 7, None, "x") for i in range(2000, 3000)]
    assert found(keyed_totals(spark.createDataFrame(data, SCHEMA), "k", "n", "w", "id")) == brute(data) == {1: (2000, 1, 2000.0), 2: (1000, 7, None)}


def test_no_partition_is_long(spark, many_partitions):
    """Keys just under any share are split as well: the longest partition has little more than its part of the rows."""
    n = 40_000
    df = spark.range(n).select("id", F.when(F.col("id") % 100 < 45, 1).when(F.col("id") % 100 < 64, 2).otherwise(F.col("id")).alias("k"), F.lit(5).alias("n"), F.lit(1.0).alias("w"))
    ranged = df.select("k", "n", F.pmod(F.xxhash64("id"), F.lit(skew.TIES)).alias("tie")).repartitionByRange("k", "n", "tie")
    seen = [r.n for r in ranged.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(seen) < 2 * n / 4
    got = found(keyed_totals(df, "k", "n", "w", "id"))
    assert got[1] == (18_000, 1, 18_000.0) and got[2] == (7_600, 1, 7_600.0) and len(got) == 2 + 14_400


def test_text_keys_and_empty(spark):
    df = spark.createDataFrame([(1, "b", "x", 1.0), (2, "b", "y", 2.0), (3, "a", None, None)], "id long, count string, n string, w double")
    assert found(keyed_totals(df, "count", "n", "w", "id")) == {"b": (2, 2, 3.0), "a": (1, 0, None)}
    assert found(keyed_totals(df.limit(0), "count", "n", "w", "id")) == {}


def test_heavy_keys(spark):
    df = spark.createDataFrame(rows(1), SCHEMA)
    assert heavy_keys(df, "k", 0.2) == [7]
    assert heavy_keys(df.limit(0), "k") == []
