import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from latticework.operators import orphans
from latticework.operators.orphans import Orphans, Reference

T0 = datetime(2024, 1, 1)
STATES = "a long, l long, set_at timestamp_ntz, gone_at timestamp_ntz, n int"
REFS = "rid long, k long, at timestamp_ntz, n int, f string, tab string"


def day(x):
    return None if x is None else T0 + timedelta(days=x)


def brute(refs, states):
    out = []
    for name, rows in refs.items():
        for rid, k, at, *_ in rows:
            if k is None:
                continue
            live = at is not None and any(a == k and s is not None and s <= at and (g is None or g > at) for a, _, s, g, _ in states)
            if not live:
                out.append((name, rid, None if at is None else at.year * 100 + at.month))
    return sorted(out, key=str)


def moment(seconds):
    return (F.lit(1_700_000_000) + seconds).cast("timestamp").cast("timestamp_ntz")


def run(spark, refs, states, **how):
    parts = [Reference(name, spark.createDataFrame(rows, REFS), "k", "at", "rid") for name, rows in refs.items()]
    return Orphans(parts, spark.createDataFrame(states, STATES), "a", "set_at", "gone_at", **how)


def data(seed):
    rng = random.Random(seed)
    key = lambda: None if rng.random() < 0.05 else 0 if rng.random() < 0.4 else rng.randrange(40)
    when = lambda p: None if rng.random() < p else rng.randrange(300)
    states = []
    for _ in range(150):
        s, g = when(0.05), when(0.3)
        states.append((key(), 1, day(s), day(g), 1))
        if rng.random() < 0.2:
            states.append(states[-1])
    refs = {"x": [(i, key(), day(when(0.03)), 1, "f", "t") for i in range(400)], "y": [(i, key(), day(when(0.0)), 1, "f", "t") for i in range(200)]}
    return refs, states


@pytest.mark.parametrize("seed,near,share", [(1, 64, 0.1), (2, 64, 0.001), (3, 0, 0.1), (4, 3, 0.01), (5, 0, 1.0)])
def test_like_brute_force(spark, monkeypatch, seed, near, share):
    monkeypatch.setattr(orphans, "NEAR_STATEMENTS", near)  # 0: all heavy keys are split by time
    refs, states = data(seed)
    o = run(spark, refs, states, share=share)
    got = sorted(map(tuple, o.found().collect()), key=str)
    want = brute(refs, states)
    assert got == want
    report = {(r.tab, r.yyyymm): r for r in o.report().collect()}
    assert sum(r.n_refs for r in report.values()) == len(want)
    assert all(r.n_refs == sum((t, m) == k for t, _, m in want) == r.n_missing + r.n_gone + r.n_early for k, r in report.items())
    first = {}
    for a, _, s, _, _ in states:
        if a is not None and s is not None:
            first[a] = min(s, first.get(a, s))
    for g in o.groups.collect():
        assert g.cause == ("missing" if g.key_ not in first else "gone" if g["at"] is not None and first[g.key_] <= g["at"] else "early")


def test_one_key_with_very_many_spans(spark, monkeypatch):
    """200,000 disjoint spans of one key: its slices are several, and none holds more than a small part of them."""
    made = []
    real = orphans._slice
    monkeypatch.setattr(orphans, "_slice", lambda x, bounds: made.append(len(bounds)) or real(x, bounds))
    i = F.col("id")
    states = spark.range(200_000).select(F.lit(1).alias("a"), moment(i * 20).alias("set_at"), moment(i * 20 + 10).alias("gone_at"))
    refs = spark.range(50_000).select(i.alias("rid"), F.lit(1).alias("k"), moment(i * 80 + F.when(i % 2 == 0, 5).otherwise(15)).alias("at"))
    o = Orphans([Reference("x", refs, "k", "at", "rid")], states, "a", "set_at", "gone_at")
    assert [r.row_id % 2 for r in o.found().collect()] == [1] * 25_000
    assert made == [orphans.SLICES - 1]
    assert {r.cause for r in o.groups.select("cause").distinct().collect()} == {"gone"}


def test_heavy_orphaned_group(spark):
    states = spark.createDataFrame([], STATES)
    refs = spark.range(5_000).select(F.col("id").alias("rid"), F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(7)).alias("k"), moment(F.lit(0)).alias("at"))
    o = Orphans([Reference("x", refs, "k", "at", "rid")], states, "a", "set_at", "gone_at")
    assert sorted(r.row_id for r in o.found().collect()) == list(range(5_000))


def test_empty_tables(spark):
    refs, states = data(4)
    assert run(spark, {"x": []}, states).found().count() == 0
    assert run(spark, {"x": refs["x"]}, []).found().count() == sum(r[1] is not None for r in refs["x"])
